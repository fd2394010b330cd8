"""Patterns of personal data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column


@dataclass(frozen=True)
class PIIPattern:
    name: str
    entity_type: str
    regex: str
    severity: str
    confidence: float
    validator: str | Callable[[Column], Column] | None = None
    flags: str = ""
    description: str = ""


_GROUPS = r"[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"
_PHONE = r"(?<!\d)(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)"
_HEX = r"[0-9a-fA-F]{1,4}"
#: DNS names have up to 127 labels; without a bound, long hosts overflow the stack of the regular-expression engine.
_LABELS = "{0,127}"

#: Names, types, severities and confidences, in the order that breaks ties.
PATTERNS = [
    PIIPattern("ssn_dashed", "SSN", r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", "critical", 0.95, "ssn", description="social security number with dashes"),
    PIIPattern("ssn_no_dash", "SSN", r"\b(?!000|666|9\d{2})\d{3}(?!00)\d{2}(?!0000)\d{4}\b", "critical", 0.70, "ssn", description="social security number of nine digits"),
    PIIPattern("ssn_spaced", "SSN", r"\b(?!000|666|9\d{2})\d{3}\s(?!00)\d{2}\s(?!0000)\d{4}\b", "critical", 0.90, "ssn", description="social security number with white space"),
    PIIPattern("credit_card_visa", "CREDIT_CARD", r"\b4\d{3}" + _GROUPS, "critical", 0.90, "luhn", description="card of 16 digits from 4"),
    PIIPattern("credit_card_mastercard", "CREDIT_CARD", r"\b5[1-5]\d{2}" + _GROUPS, "critical", 0.90, "luhn", description="card of 16 digits from 51-55"),
    PIIPattern("credit_card_amex", "CREDIT_CARD", r"\b3[47]\d{2}[\s-]?\d{6}[\s-]?\d{5}\b", "critical", 0.90, "luhn", description="card of 15 digits from 34 or 37"),
    PIIPattern("credit_card_discover", "CREDIT_CARD", r"\b6(?:011|5\d{2})" + _GROUPS, "critical", 0.90, "luhn", description="card of 16 digits from 6011 or 65"),
    PIIPattern("us_phone", "PHONE_NUMBER", _PHONE + r"(?!\d)", "high", 0.80, description="phone number"),
    PIIPattern("us_phone_ext", "PHONE_NUMBER", _PHONE + r"(?:\s*(?:ext|x|extension)\.?\s*\d{1,6})?(?!\d)", "high", 0.85, None, "i", "phone number, extension optional"),
    PIIPattern("email", "EMAIL_ADDRESS", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", "high", 0.95, description="e-mail address"),
    PIIPattern("ipv4", "IP_ADDRESS", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", "medium", 0.85, "ipv4", description="IPv4 address"),
    PIIPattern("ipv6", "IP_ADDRESS", rf"\b(?:{_HEX}:){{7}}{_HEX}\b|\b(?:{_HEX}:){{1,7}}:\b|\b::(?:{_HEX}:){{0,5}}{_HEX}\b|\b(?:{_HEX}:){{1,6}}:{_HEX}\b", "medium", 0.80, description="IPv6 address"),
    PIIPattern("employee_id", "EMPLOYEE_ID", r"\bEMP-\d{5,8}\b", "medium", 0.95, None, "i", "employee number"),
    PIIPattern("internal_url", "INTERNAL_URL", rf"https?://(?:[a-zA-Z0-9\-]+\.){_LABELS}(?:internal|corp|intranet|private|local|staging|dev)(?:\.[a-zA-Z0-9\-]+){_LABELS}(?::\d{{1,5}})?(?:/\S*)?", "medium", 0.90, description="URL of an internal host"),
    PIIPattern("date_of_birth", "DATE_OF_BIRTH", r"\b(?:0[1-9]|1[0-2])[/\-](?:0[1-9]|[12]\d|3[01])[/\-](?:19|20)\d{2}\b", "high", 0.60, description="date, month first"),
    PIIPattern("us_passport", "PASSPORT_NUMBER", r"\b[A-Z]\d{8}\b", "critical", 0.60, description="letter and eight digits"),
    PIIPattern("us_drivers_license", "DRIVERS_LICENSE", r"\b[A-Z]\d{7,14}\b", "high", 0.40, description="letter and 7 to 14 digits"),
    PIIPattern("us_routing_number", "BANK_ROUTING_NUMBER", r"\b(?:0[1-9]|[1-2]\d|3[0-2])\d{7}\b", "high", 0.50, description="nine digits from 01-32"),
]

#: What the labels of named-entity models stand for, their severities and confidences.
NER_TYPES = {"PERSON": "PERSON_NAME", "ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION", "NORP": "ORGANIZATION", "FAC": "LOCATION", "DATE": "DATE", "MONEY": "FINANCIAL"}
NER_CONFIDENCES = {"PERSON": 0.85, "ORG": 0.75, "GPE": 0.75, "LOC": 0.70, "NORP": 0.65, "FAC": 0.65, "DATE": 0.60, "MONEY": 0.80}
NER_SEVERITIES = {"PERSON_NAME": "high", "ORGANIZATION": "medium", "LOCATION": "low", "DATE": "low", "FINANCIAL": "high"}

#: The same for the labels of an analyzer service.
ANALYZER_TYPES = {
    "PERSON": "PERSON_NAME",
    "EMAIL_ADDRESS": "EMAIL_ADDRESS",
    "PHONE_NUMBER": "PHONE_NUMBER",
    "CREDIT_CARD": "CREDIT_CARD",
    "US_SSN": "SSN",
    "US_PASSPORT": "PASSPORT_NUMBER",
    "US_DRIVER_LICENSE": "DRIVERS_LICENSE",
    "IP_ADDRESS": "IP_ADDRESS",
    "IBAN_CODE": "BANK_ACCOUNT",
    "US_BANK_NUMBER": "BANK_ACCOUNT",
    "LOCATION": "LOCATION",
    "DATE_TIME": "DATE",
    "NRP": "ORGANIZATION",
    "MEDICAL_LICENSE": "MEDICAL_ID",
    "URL": "URL",
}
ANALYZER_SEVERITIES = {
    "PERSON_NAME": "high",
    "EMAIL_ADDRESS": "high",
    "PHONE_NUMBER": "high",
    "CREDIT_CARD": "critical",
    "SSN": "critical",
    "PASSPORT_NUMBER": "critical",
    "DRIVERS_LICENSE": "high",
    "IP_ADDRESS": "medium",
    "BANK_ACCOUNT": "critical",
    "LOCATION": "low",
    "DATE": "low",
    "ORGANIZATION": "medium",
    "MEDICAL_ID": "critical",
    "URL": "low",
}
