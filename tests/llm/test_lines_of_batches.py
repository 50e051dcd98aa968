"""The lines of a text are its own, whichever texts stand beside it in a batch."""

import pyarrow as pa
import pytest

from furlong.llm import repetition
from furlong.llm.words import texts_of


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        (["ab\nab", "x"], [1, 0]),  # the last line of a text that another one follows is whole
        (["ab\nabc", "x"], [0, 0]),
        (["a\n\nb\nb", None, "", "b\nb\n", "b"], [1, 0, 0, 1, 0]),
        (["é\né", "é", "\n", " \n \nz\nz"], [1, 0, 0, 1]),
    ],
)
def test_repeated_lines(rows, want):
    (texts,) = texts_of(pa.array(rows))
    assert repetition.rule_columns(texts, 10, 0.3, 300)["n_dup_lines"].tolist() == want
