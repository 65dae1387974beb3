import numpy as np
import pytest
from odd import odd
from test_packing import PATH, check

from marketframe.llm import packing, tokens

RUNS = [" " * 1_200_000 + "a", "\n" * 1_200_000, "x" + " \n" * 600_000 + "end"]


@pytest.mark.parametrize("text", RUNS, ids=["spaces", "newlines", "both"])
def test_long_runs_have_the_ids_of_the_tokenizers_library(text):
    want = tokens.load(PATH).encode(text, add_special_tokens=False).ids
    assert np.array_equal(tokens.ids(PATH, text), want)


def test_a_document_with_a_long_run_is_packed(spark):
    rows = [(1, "some words before", "s"), (2, RUNS[0], "s"), (3, RUNS[1], "s")]
    check(packing.pack(odd(spark, rows)).collect(), [(i, t) for i, t, _ in rows], packing.WINDOW)
