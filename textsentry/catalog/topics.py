"""Vocabulary of topics."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Topic:
    name: str
    keywords: tuple[str, ...]
    phrases: tuple[str, ...] = ()
    boost: float = 1.0


#: Keywords and phrases by topic.
TOPICS = [
    Topic(
        "technology",
        ("software", "hardware", "computer", "programming", "code", "algorithm", "database", "api", "server", "cloud", "network", "machine learning", "artificial intelligence", "ai", "ml", "data", "engineering", "developer", "deploy", "infrastructure"),
        ("machine learning", "artificial intelligence", "deep learning", "open source", "cloud computing", "data science"),
    ),
    Topic(
        "business",
        ("revenue", "profit", "market", "strategy", "sales", "customer", "investment", "startup", "enterprise", "growth", "roi", "acquisition", "partnership", "stakeholder", "budget"),
        ("business model", "market share", "supply chain", "return on investment", "go to market"),
    ),
    Topic(
        "health",
        ("medical", "health", "disease", "treatment", "diagnosis", "patient", "clinical", "therapy", "symptom", "vaccine", "hospital", "doctor", "medication", "wellness", "nutrition"),
        ("mental health", "clinical trial", "side effects", "health care", "public health"),
    ),
    Topic(
        "science",
        ("research", "experiment", "hypothesis", "theory", "physics", "chemistry", "biology", "study", "peer-reviewed", "journal", "discovery", "laboratory", "evidence", "observation", "analysis"),
        ("peer review", "scientific method", "control group", "climate change", "natural selection"),
    ),
    Topic(
        "education",
        ("learning", "teaching", "student", "curriculum", "school", "university", "course", "classroom", "academic", "professor", "degree", "scholarship", "lecture", "exam", "education"),
        ("higher education", "online learning", "student loan", "distance education"),
    ),
]
