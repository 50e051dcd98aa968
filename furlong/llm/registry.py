"""The queries of this subpackage: opN_<name> for each operator, and the SQL where SQL can express it."""

from __future__ import annotations

import os

from furlong.llm import (
    decontamination,
    divergence,
    html_text,
    jaccard_join,
    language,
    lattice_lm,
    pieces,
    private,
    ranked_search,
    repetition,
    secrets,
    substrings,
    token_files,
)

_MODULES = (
    secrets, jaccard_join, substrings, html_text, private, language, repetition, lattice_lm, decontamination, pieces,
    ranked_search, token_files, divergence,
)



def visible(query):
    """The query, run so that Python workers on this machine can import this library too."""

    def run(spark, sf_dir):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        paths = spark.sparkContext.environment.setdefault("PYTHONPATH", "").split(os.pathsep)
        if root not in paths:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
        return query(spark, sf_dir)

    return run


QUERIES = {m.NAME: visible(m.query) for m in _MODULES}
ORACLE = {m.NAME: m.SQL for m in _MODULES if m.SQL}
