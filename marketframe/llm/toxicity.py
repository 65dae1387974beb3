"""Toxicity by a learned lexicon, misspellings caught by automata, and the context of each hit.

The lexicon is learned: words and word beginnings that are much likelier in toxic than in other
labelled documents, counted by distinct neighbours so that copies of one document count once.
A word that isn't in the lexicon runs through a trie of its terms together with its
Levenshtein automaton, kept as one bit vector per number of errors; a branch ends when no
state is left. Each hit is weighed by its window: quotation marks around it and words that
report speech lower it, words that address someone raise it. A document's score is
logistic in the sums of its hits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import settle, text_or_empty
from marketframe.llm.learn import Constant, held_out, sigmoid

#: Labelled rows to learn from: toxic ones and others, each the first by a hash of the id.
TOXIC_ROWS, OTHER_ROWS = 4000, 8000
LEAST_SEEN, LEAST_ODDS = 4, 3.0
PREFIXES = range(4, 8)
CONTEXT = 8
KEEP = 0.5
MEMO = 400_000
LOOKED_UP: dict[str, dict] = {}

QUOTES = "\"“”„«»‘’‹›"
EDGES = QUOTES + "'.,;:!?()[]{}<>…*_~`|/\\-–—#%&$@+="
REPORTING = frozenset(
    "said says saying called calls wrote writes quoted quote quotes reported according word words term insult slur "
    "sagte schrieb nannte zitierte zitat wort laut dit disait appelé écrit cité selon mot dijo llamó escribió citó según palabra".split()
)
ADDRESS = frozenset("you your you're youre u du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti eres usted ustedes vosotros".split())


def normal(chunk: str) -> str:
    """A word without the marks around it, in lower case."""
    return chunk.strip(EDGES).lower()


def errors_allowed(n: int) -> int:
    return 0 if n < 5 else 1 if n < 9 else 2


def pair_bits(words: list[str]) -> np.ndarray:
    """Two 64-bit words for each word: a bit for the hash of each pair of neighbouring letters, edges included."""
    out = np.zeros((len(words), 2), np.uint64)
    if not words:
        return out
    text = np.array([f"\1{w}\1" for w in words])
    code = text.view(np.uint32).reshape(len(words), -1).astype(np.uint64)
    for a, b in zip(code.T[:-1], code.T[1:], strict=True):
        h = (a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA77)) >> np.uint64(13)
        bit = np.where(b > 0, np.uint64(1) << (h & np.uint64(63)), np.uint64(0))
        second = (h >> np.uint64(6) & np.uint64(1)).astype(bool)
        out[:, 0] |= np.where(second, np.uint64(0), bit)
        out[:, 1] |= np.where(second, bit, np.uint64(0))
    return out


class Trie:
    """Terms as a trie; each node knows the letters and lengths below it, to leave hopeless branches."""

    def __init__(self, terms: list[str]):
        self.nodes: list[tuple[dict[str, int], list[int]]] = [({}, [])]
        self.need: list[int] = [-1]
        self.lengths: list[int] = [0]
        self.terms = terms
        self._by_length: list[tuple[int, np.ndarray]] | None = None
        self._pieces: tuple[dict, dict, dict] | None = None
        self.bits = {c: 1 << i for i, c in enumerate(sorted({c for t in terms for c in t}))}
        for no, t in enumerate(terms):
            letters, at = self.letters(t), 0
            self._below(0, letters, len(t))
            for c in t:
                children = self.nodes[at][0]
                if c not in children:
                    children[c] = len(self.nodes)
                    self.nodes.append(({}, []))
                    self.need.append(-1)
                    self.lengths.append(0)
                at = children[c]
                self._below(at, letters, len(t))
            self.nodes[at][1].append(no)

    def letters(self, word: str) -> int:
        out = 0
        for c in word:
            out |= self.bits.get(c, 0)
        return out

    def _below(self, node: int, letters: int, n: int) -> None:
        self.need[node] &= letters
        self.lengths[node] |= 1 << n

    def possible(self, words: list[str]) -> np.ndarray:
        """For each word whether a term's length and letter pairs leave a chance that ``near`` finds one.

        An error spoils at most two of a term's pairs of neighbouring letters (its start and end
        count as letters), so of a term within e errors the word lacks at most 2 e pairs. Pairs
        are kept as bits by a hash, which can only hide a lack. All words are compared at once.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        most = np.array([0] * 4 + [1] * 4 + [2])[np.minimum(sizes, 8)]  # errors_allowed(length + 1)
        out = np.zeros(len(words), bool)
        kept = np.flatnonzero((most > 0) & (sizes <= 60))
        if self._by_length is None:
            terms = sorted(set(self.terms))
            size, pairs = np.array([len(t) for t in terms], np.int64), pair_bits(terms)
            self._by_length = [(n, np.unique(pairs[size == n], axis=0)) for n in np.unique(size)]
        for at in range(0, len(kept), 4096):
            some = kept[at : at + 4096]
            mine = pair_bits([words[i] for i in some])
            for n, theirs in self._by_length:
                allowed = np.minimum(most[some], errors_allowed(int(n)))
                rows = np.flatnonzero(~out[some] & (np.abs(sizes[some] - n) <= allowed))
                if len(rows):
                    lacks = np.bitwise_count(theirs[None, :, :] & ~mine[rows, None, :]).sum(axis=2)
                    out[some[rows]] = (lacks <= 2 * allowed[rows][:, None]).any(axis=1)
        return out

    def shares_piece(self, word: str) -> bool:
        """Whether a piece of a term stands where an untouched one would; ``near`` finds nothing without one.

        Of a term that allows e errors, cut into e + 1 pieces, e errors leave one piece as it is. One error lies before the
        second half, which then ends the word, or after the first, which then begins it; two shift a piece by two letters at most.
        """
        if self._pieces is None:
            heads, tails, spots = {}, {}, {}
            for t in self.terms:
                n = len(t)
                if errors_allowed(n) == 1:
                    heads.setdefault(n // 2, set()).add(t[: n // 2])
                    tails.setdefault(n - n // 2, set()).add(t[n // 2 :])
                elif errors_allowed(n) == 2:
                    for a, b in ((0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n)):
                        for at in range(max(0, a - 2), a + 3):
                            spots.setdefault((at, at + b - a), set()).add(t[a:b])
            self._pieces = heads, tails, spots
        heads, tails, spots = self._pieces
        for n, pieces in heads.items():
            if word[:n] in pieces:
                return True
        for n, pieces in tails.items():
            if word[-n:] in pieces:
                return True
        if len(word) > 6:
            for (a, b), pieces in spots.items():
                if word[a:b] in pieces:
                    return True
        return False

    def near(self, word: str) -> tuple[int, int] | None:
        """(errors, number of the term) of the nearest term within its allowed errors, or None."""
        n = len(word)
        most = errors_allowed(n + 1)  # a term of more letters may allow an error more
        if most == 0 or n > 60:
            return None
        lengths = ((1 << (2 * most + 1)) - 1) << n >> most
        if not self.lengths[0] & lengths:
            return None
        mine, masks = self.letters(word), {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        goal, best = 1 << n, None
        stack = [(0, tuple((1 << (e + 1)) - 1 for e in range(most + 1)))]
        while stack:
            node, state = stack.pop()
            children, ends = self.nodes[node]
            for no in ends:
                for e in range(min(most, errors_allowed(len(self.terms[no]))) + 1):
                    if state[e] & goal:
                        best = min(best or (9, 0), (e, no))
                        break
            for c, child in children.items():
                if not self.lengths[child] & lengths or (self.need[child] & ~mine).bit_count() > most:
                    continue
                mask = masks.get(c, 0)
                row = (state[0] & mask) << 1
                following = [row]
                for e in range(1, most + 1):
                    # A letter matched; one replaced or missing in the word; one too many in it.
                    row = (state[e] & mask) << 1 | state[e - 1] << 1 | state[e - 1] | row << 1
                    following.append(row)
                if row:
                    stack.append((child, tuple(following)))
        return best


class Lexicon:
    """Terms with weights: whole words, beginnings, and what is misspelt."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], fuzzy: list[str], harmless: frozenset = frozenset()):
        self.words, self.beginnings, self.fuzzy, self.harmless = words, beginnings, fuzzy, harmless
        self.trie, self.memo = Trie(fuzzy), {}
        self.heads = {b[: PREFIXES[0]] for b in beginnings}

    def digest(self) -> str:
        parts = repr((sorted(self.words.items()), sorted(self.beginnings.items()), self.fuzzy, sorted(self.harmless)))
        return xxhash.xxh128_hexdigest(parts.encode())

    def __getstate__(self):
        return {"words": self.words, "beginnings": self.beginnings, "fuzzy": self.fuzzy, "harmless": self.harmless}

    def __setstate__(self, state):
        self.__init__(**state)
        # The tasks of one worker share what was looked up; only the last lexicon's is held.
        mine = self.digest()
        if mine not in LOOKED_UP:
            LOOKED_UP.clear()
        self.memo = LOOKED_UP.setdefault(mine, {})

    def look_up(self, word: str, near: bool = True) -> tuple[str, float, int] | None:
        """(term, weight, errors) of a normal word; ``near`` tells whether it may be a misspelt term."""
        if word in self.words:
            return word, self.words[word], 0
        if word[: PREFIXES[0]] in self.heads:
            begins = [(self.beginnings[word[:n]], word[:n]) for n in PREFIXES if len(word) > n and word[:n] in self.beginnings]
            if begins:
                weight, term = max(begins)
                return f"{term}*", weight, 0
        found = self.trie.near(word) if near and word not in self.harmless and self.trie.shares_piece(word) else None
        if found and found[0]:
            term = self.fuzzy[found[1]]
            return term, self.words[term] * 0.8 ** found[0], found[0]
        return None

    def parts(self, chunk: str) -> list[str]:
        """A run of characters as a normal word, and its parts between hyphens and the like."""
        whole = normal(chunk)
        if whole.isalnum():
            return [whole] if len(whole) > 2 else []
        words = {whole}
        if whole:
            words |= {normal(p) for p in whole.replace("/", "-").replace("_", "-").replace("’", "'").replace("'", "-").split("-")}
        return sorted(w for w in words if len(w) > 2)

    def learn(self, chunks) -> None:
        """Look up the given runs of characters, each once; only words that may be near a term walk the trie."""
        fresh = [c for c in chunks if c not in self.memo]
        if len(self.memo) + len(fresh) > MEMO:
            self.memo.clear()
            fresh = list(chunks)
        parts = [self.parts(c) for c in fresh]
        words = list({w for p in parts for w in p})
        chance = self.trie.possible(words)
        known, at, heads = {}, PREFIXES[0], self.heads
        for w, near in zip(words, chance.tolist(), strict=True):
            if not near and w not in self.words and w[:at] not in heads:
                continue
            x = self.look_up(w, near)
            if x:
                known[w] = (x[1], x[0], x[2], w)
        self.memo.update(dict.fromkeys(fresh))
        for c, p in zip(fresh, parts, strict=True):
            if known.keys().isdisjoint(p):
                continue
            weight, term, errors, word = max(known[w] for w in p if w in known)
            self.memo[c] = (term, weight, errors, word)

    def prepared(self, texts: list[str]):
        """The texts, after the words of as many as ``MEMO`` has room for were looked up together."""
        held, words = [], set()
        for t in texts:
            held.append(t)
            words.update(t.split())
            if len(words) > MEMO // 2:
                self.learn(words)
                yield from held
                held, words = [], set()
        self.learn(words)
        yield from held

    def hit(self, chunk: str) -> tuple[str, float, int, str] | None:
        """The hit of a run of characters, or of the strongest of its parts."""
        if chunk not in self.memo:
            self.learn([chunk])
        return self.memo[chunk]

    def hits(self, text: str) -> list[tuple]:
        """(word number, term, weight, errors, form, quoted, reported, addressed) of each hit."""
        chunks = text.split()
        memo = self.memo
        try:
            looked = list(map(memo.__getitem__, chunks))
        except KeyError:
            self.learn(dict.fromkeys(chunks))
            looked = list(map(memo.__getitem__, chunks))
        out = []
        for i in [i for i, x in enumerate(looked) if x]:
            before, after = chunks[max(0, i - CONTEXT) : i], chunks[i + 1 : i + 1 + CONTEXT]
            opened = sum(c[0] in QUOTES for c in [*before, chunks[i]]) - sum(c.rstrip(".,;:!?")[-1:] in QUOTES and c[-1:] != "" for c in before if len(c) > 1)
            closed = any(c.rstrip(".,;:!?")[-1:] and c.rstrip(".,;:!?")[-1] in QUOTES for c in [chunks[i], *after])
            near = {normal(c) for c in before + after}
            out.append((i, *memo[chunks[i]], opened > 0 and closed, bool(near & REPORTING), bool(near & ADDRESS)))
        return out

    def features(self, text: str) -> tuple[float, float, float]:
        """Log of the sum of the weighed hits, the greatest, and their sum per 100 words (at most 20)."""
        found = self.hits(text)
        if not found:
            return 0.0, 0.0, 0.0
        weighed = [h[2] * (0.5 if h[5] else 1.0) * (0.6 if h[6] else 1.0) * (1.2 if h[7] else 1.0) for h in found]
        return math.log1p(sum(weighed)), max(weighed), min(20.0, 100.0 * sum(weighed) / max(len(text.split()), 20))


class Logistic:
    """Logistic regression with weighted rows and a small ridge, by Newton's steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0):
        self.scale = np.abs(x).max(axis=0) + 1e-6
        x = np.column_stack([x / self.scale, np.ones(len(x))])
        penalty = np.full(x.shape[1], ridge)
        penalty[-1] = 1e-3
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = sigmoid(x @ w)
            slope = x.T @ (weight * (y - p)) - penalty * w
            bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(bend, slope)
            w += step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((x / self.scale) @ self.w[:-1] + self.w[-1])


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, judge):
        self.lexicon, self.judge = lexicon, judge

    def scores(self, texts: list[str]) -> np.ndarray:
        x = [self.lexicon.features(t) for t in self.lexicon.prepared(texts)]
        return self.judge(np.array(x, float).reshape(-1, 3))

    def column(self, text_col: str = "text") -> Column:
        """The score of a text as a column."""

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            return pd.Series(self.scores(texts.tolist()))

        return score(text_or_empty(text_col))

    def hits(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per hit: doc_id, word_no, term, weight, errors, form, quoted, reported, addressed."""

        def run(batches):
            for b in batches:
                texts = self.lexicon.prepared(b.column(1).to_pylist())
                rows = [(i, *h) for i, t in zip(b.column(0).to_pylist(), texts, strict=True) for h in self.lexicon.hits(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)], [n for n, _ in fields])

        fields = [("doc_id", pa.int64()), ("word_no", pa.int64()), ("term", pa.string()), ("weight", pa.float64()), ("errors", pa.int64()),
                  ("form", pa.string()), ("quoted", pa.bool_()), ("reported", pa.bool_()), ("addressed", pa.bool_())]
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
        return rows.mapInArrow(run, "doc_id long, word_no long, term string, weight double, errors long, form string, quoted boolean, reported boolean, addressed boolean")


def terms_of(text: str):
    """The terms of a text with a hash of the neighbours where each first occurs: words, and beginnings as ``abcd*``."""
    words = [normal(c) for c in text.split()]
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        if len(w) < 3 or w in out:
            continue
        around = f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"
        place = xxhash.xxh64_intdigest(around.encode()) >> 1
        out[w] = place
        for n in PREFIXES:
            if len(w) > n:
                out.setdefault(f"{w[:n]}*", place)
    return out.items()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS,
        id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Lexicon and weights from at most ``toxic_rows`` and ``other_rows`` labelled rows that aren't held out.

    Of several labels of an id the largest counts. Without labels of both kinds there is no
    lexicon, and every score is the share of label 1, one half if there are none.
    """
    usable = labels.where(~held_out(id_col) & F.col(label).isin(0, 1))
    one = settle(usable.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label")))
    totals = dict(one.groupBy("label").count().collect())
    first = lambda v, n: one.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = F.broadcast(first(1, toxic_rows).union(first(0, other_rows)))  # so many rows of two numbers
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sample = settle(rows.join(chosen, "doc_id").select("doc_id", "label", "text"))
    n = dict(sample.groupBy("label").agg(F.countDistinct("doc_id")).collect())
    if len(n) < 2:
        return ToxicityModel(Lexicon({}, {}, []), Constant(np.repeat([0, 1], [totals.get(0, 0), totals.get(1, 0)])))

    def terms(batches):
        for b in batches:
            found = [x for t in b.column(0).to_pylist() for x in terms_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([p for _, p in found], pa.int64())], ["term", "place"])

    found = lambda v: sample.where(F.col("label") == v).select("text").mapInArrow(terms, "term string, place long")
    places = found(1).distinct().groupBy("term").agg(F.count("*").alias("k")).where(F.col("k") >= LEAST_SEEN)
    other = found(0).groupBy("term").agg(F.count("*").alias("other"))
    ratio = F.log((F.col("k") + 0.5) / (n[1] + 1)) - F.log((F.coalesce("other", F.lit(0)) + 0.5) / (n[0] + 1))
    telling = places.join(other, "term", "left").select("term", "k", ratio.alias("odds")).where(F.col("odds") >= LEAST_ODDS)
    # All of them, however many: the sample's size bounds them.
    seen = {r.term: (r.k, r.odds) for r in telling.collect()}
    odds = {t: o for t, (_, o) in seen.items()}
    kept = sorted(odds, key=lambda t: (-odds[t] * math.log(seen[t][0]), t))
    words = {t: odds[t] for t in kept if not t.endswith("*")}
    beginnings = {t[:-1]: odds[t] for t in kept if t.endswith("*")}
    fuzzy = [t for t in words if errors_allowed(len(t))]
    lexicon = Lexicon(words, beginnings, fuzzy)

    # Forms near a term that other documents use are words of their own; a term with many such neighbours isn't looked for.
    near = ToxicityModel(lexicon, None).hits(sample.where("label = 0")).where("errors > 0").select("term", "form", "doc_id").distinct()
    forms = settle(near.groupBy("term", "form").count())
    harmless = frozenset(r[0] for r in forms.where("count > 1").select("form").distinct().collect())
    common = forms.where("count = 1").groupBy("term").count().where(F.col("count") > max(4, 0.003 * n[0])).collect()  # at most a row a term
    common = {r[0] for r in common}
    lexicon = Lexicon(words, beginnings, [t for t in fuzzy if t not in common], harmless)

    def features(batches):
        for b in batches:
            x = [list(lexicon.features(t)) for t in lexicon.prepared(b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    pdf = sample.select("doc_id", "label", "text").mapInArrow(features, "doc_id long, label int, x array<double>")
    pdf = pdf.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    x, y = np.stack(pdf["x"].to_list()), pdf["label"].to_numpy(float)
    share = {v: totals[v] / max(1, (y == v).sum()) for v in (0, 1)}
    return ToxicityModel(lexicon, Logistic(x, y, np.where(y == 1, share[1], share[0])))
