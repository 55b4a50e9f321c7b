"""Operators for preparing training data; nothing outside this package imports it.

Executors import the package, too: it is installed there, on their PYTHONPATH, or sent with the job (--py-files). What a Python worker
learns stays in module variables and serves its next task.
"""
