"""Operators for preparing large text corpora for language-model training.

Nothing outside this subpackage imports it.  Each operator is a module with its
own general interface; ``queries`` binds them to the tables of the driver.
"""
