from collections import Counter

import pytest
from odd import LONG, TEXTS, empty, odd

from marketframe.llm import token_counts, tokens

ODD = [
    "a<|endoftext|>b <|EndOfText|> <|startoftext|>x", "H̱ İstanbul ΑΣ ΣΑΣ. é É́ Ångström K", "it's I'LL don't 'SS x's 're",
    "\x1c\x1d a\xa0b c 漢字かな", "ǅ ŉ ſs ß ẞ ª º ² ½ 12 3४", "one,two;three--four 3.14 <|x|> <|", "é ́x ño", "\ndocs docs",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_equal_the_library(spark, name):
    path = tokens.tokenizer_path(name)
    rows = TEXTS + [(100 + i, t, "s") for i, t in enumerate(ODD)]
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd(spark, rows), path).collect())
    want = tokens.counts(path, [t or "" for _, t, _ in rows])
    assert got == Counter((i, len((t or "").encode()), n, n > 2048) for (i, t, _), n in zip(rows, want, strict=True))


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(token_counts, "HELD", 50)
    rows = [(i, f"common words w{i} w{i % 7}, {LONG[: i * 13 % 900]}", "s") for i in range(200)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(odd(spark, rows)).collect()}
    want = tokens.counts(tokens.tokenizer_path("word_bpe_49k.json"), [t for _, t, _ in rows])
    assert [got[i] for i in range(200)] == want


def test_empty_table_and_files_without_pretokens(spark):
    assert token_counts.token_counts(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        token_counts.drops_space(tokens.tokenizer_path("piece_bpe_32k.model"))
