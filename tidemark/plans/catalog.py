"""Every query of the library by name, with its SQL where SQL can express it."""

from . import files, parsing, texts, weekly

QUERIES = weekly.QUERIES | texts.QUERIES | files.QUERIES | parsing.QUERIES
ORACLES = weekly.ORACLES | texts.ORACLES | files.ORACLES | parsing.ORACLES
