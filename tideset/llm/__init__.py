"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Ten operators, one module each; `queries` holds the thin queries over the
standard tables and their SQL, `common` what several operators share.
"""
