"""Operators that prepare text for language-model training.

Ten operators, one module each.  Nothing outside this folder (and
``corpus_pipeline.py``) imports them.  They share three conventions:

* a null text counts as an empty text, and only the columns named by the
  arguments are read, so extra columns never clash;
* intermediate tables go to the folder in ``spark.checkpoint.dir``
  (:func:`textsentry.llm._run.shared_dir`), never to a machine's own disk;
* what is collected or broadcast has a bound that does not depend on the
  number of rows; the bound is a parameter of the operator.
"""
