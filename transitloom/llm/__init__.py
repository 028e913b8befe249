"""Operators for preparing language-model training data at cluster scale.

Conventions shared by all of them:

* An operator reads only the columns named in its arguments. Other columns of its
  input are never looked at, so they cannot clash with what it returns.
* A null text counts as the empty text, and whole texts are processed.
* Repeated input rows give repeated output rows, unless the docstring says otherwise.
* Intermediate tables go to the folder in ``spark.checkpoint.dir``.
"""
