"""Secret scan: strong spans by pattern, weak ones by linking the parts of a credential.

A credential has parts: an access identifier, a secret, an endpoint. Some parts can be told by
their form alone (the strong kinds); others look like ordinary text (the weak kinds) and count
only where a complementary part lies within ``scope`` code points of the same document. The
interval join of parts is a merge: parts are sorted by their start, and running maxima of the
complements' ends (and, sorted the other way, minima of their starts) give the nearest
complement on either side, so a document with n parts costs n log n and emits no pairs.

All of it is DataFrame functions. Texts stay where they are read; only spans are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = 200

IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"


def any_case(word: str) -> str:
    """A pattern for ASCII letters of ``word`` in either case; what follows a letter as ? stays."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def assigned(words: list[str], value: str) -> str:
    return f"({'|'.join(any_case(w) for w in words)})[\"']?\\x20*[:=]\\x20*[\"']?({value})"


#: kind -> (pattern, group whose length counts, least length, role, strong). The strong kinds'
#: words, classes and lengths are fixed values; hex and access are written with their least length, which
#: finds the same spans, since what remains of a run that is too short is shorter still.
KINDS = {
    "assign": (assigned(["password", "passwd", "secret", "token", "api_?key"], "[A-Za-z0-9+/_.=-]+"), 2, 12, SECRET, True),
    "access": ("AKIA[A-Z0-9]{14,}", 0, 18, IDENTIFIER, True),
    "hex": ("[0-9a-f]{16,}", 0, 16, SECRET, True),
    "weak_id": (
        assigned(["user", "username", "login", "account", "client_?id", "access_?key_?id"], "[A-Za-z0-9@_.-]+"), 2, 3, IDENTIFIER, False,
    ),
    "weak_secret": ("[A-Za-z0-9+/_=-]{20,}", 0, 20, SECRET, False),
    "weak_assign": (assigned(["pwd", "pass", "password", "passwd", "secret", "token", "key"], "[^\\x20\\x09-\\x0D\"']+"), 2, 4, SECRET, False),
    "endpoint": ("[a-z][a-z0-9+.-]*://[^\\x20\\x09-\\x0D\"'<>]+", 0, 8, ENDPOINT, False),
}
ORDER = list(KINDS)


def may_match(text: Column, kind: str) -> Column:
    """False only where a kind cannot occur: a plain search costs a fraction of its pattern."""
    if kind == "access":
        return text.contains("AKIA")
    if kind == "endpoint":
        return text.contains("://")
    return (text.contains(":") | text.contains("=")) if KINDS[kind][1] else F.lit(True)


def found(text: Column, kind: str) -> Column:
    """Every match of a kind, the failing ones too: kind_no, nth, gap before it, its length, value, ok."""
    pattern, group, least, _, _ = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(whole.alias("w"), counted.alias("c"), F.split(text, pattern, -1).alias("g"))

    def one(x: Column, i: Column) -> Column:
        ok = F.length(x["c"]) >= least
        if kind == "weak_secret":  # random strings mix cases and digits, words don't
            ok = ok & x["w"].rlike("[0-9]") & x["w"].rlike("[A-Z]") & x["w"].rlike("[a-z]")
        return F.struct(
            F.lit(ORDER.index(kind)).alias("kind_no"), i.alias("nth"), F.length(x["g"]).cast("long").alias("gap"),
            F.length(x["w"]).cast("long").alias("len"), x["w"].alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"),
        )

    # The last element holds only the gap after the last match.
    spans = F.filter(F.transform(zipped, one), lambda x: x["value"].isNotNull())
    none = F.array().cast("array<struct<kind_no:int,nth:int,gap:bigint,len:bigint,value:string,ok:boolean>>")
    return F.when(may_match(text, kind) & text.rlike(pattern), spans).otherwise(none)


def is_kind(test) -> Column:
    return F.col("kind_no").isin([ORDER.index(k) for k, v in KINDS.items() if test(v)])


def located(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_no, doc_id, kind_no, start, end, value, ok): all matches, and a row without kind for a document without any.

    row_no tells the rows of ``docs`` apart within this plan; ids may be null or repeat.
    """
    text = F.col("__text")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
    )
    rows = rows.select("row_no", "doc_id", F.explode_outer(F.concat(*[found(text, k) for k in KINDS])).alias("s"))
    rows = rows.select("row_no", "doc_id", "s.*").repartition("row_no")
    so_far = Window.partitionBy("row_no", "kind_no").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far)).select(
        "row_no", "doc_id", "kind_no", (F.col("end") - F.col("len")).alias("start"), "end", "value", "ok"
    )


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``parts`` of ``located`` with ``reported``: strong spans, and weak ones linked to a complement.

    Of weak spans that overlap a strong one, or a weak one that starts earlier (or at the same
    place with an earlier kind), none counts. An identifier and an endpoint need a secret within
    ``scope`` code points between the spans, a secret needs an identifier or an endpoint.
    """
    strong = is_kind(lambda v: v[4])
    by_row = Window.partitionBy("row_no", "ok")
    before = by_row.orderBy("start", "kind_no", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = by_row.orderBy(F.desc("start"), F.desc("kind_no"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({
        "__past": F.max("end").over(before), "__strong_next": F.min(F.when(strong, F.col("start"))).over(after),
    })
    free = (F.coalesce("__past", F.lit(0)) <= F.col("start")) & (F.col("end") <= F.coalesce("__strong_next", F.col("end")))
    parts = parts.withColumn("ok", F.col("ok") & (strong | free))

    def near(role: str) -> Column:
        here = is_kind(lambda v: v[3] == role)
        # Strong spans may overlap each other: their ends are cut at this start, which is a distance of 0.
        left = F.col("start") - F.max(F.when(here, F.col("end"))).over(before) <= scope
        right = F.min(F.when(here, F.col("start"))).over(after) - F.col("end") <= scope
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    parts = parts.withColumns({f"__{r}": near(r) for r in (IDENTIFIER, SECRET, ENDPOINT)})
    role = lambda r: is_kind(lambda v: v[3] == r)
    complement = F.when(role(SECRET), F.col(f"__{IDENTIFIER}") | F.col(f"__{ENDPOINT}")).otherwise(F.col(f"__{SECRET}"))
    return parts.select(
        "row_no", "doc_id", "kind_no", "start", "end", "value", (F.col("ok") & (strong | complement)).alias("reported")
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per reported span: doc_id, kind, role, start, end (code points, end exclusive), value, strong."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v[3]).alias("role"), F.lit(v[4]).alias("strong")) for k, v in KINDS.items()])
    spans = linked(located(docs, id_col, text_col), scope).where("reported").withColumn("k", kinds[F.col("kind_no")])
    return spans.select("doc_id", "k.kind", "k.role", "start", "end", "value", "k.strong")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    ``spans`` lists kind:start:end of all reported spans by start, then kind, and base_sha256 is
    the SHA-256 of the same list of strong spans. Null and empty texts have empty lists. Ids may
    be null or repeat; repeated rows are reported as often. Other columns are ignored.
    """
    spans = linked(located(docs, id_col, text_col), scope)
    strong = is_kind(lambda v: v[4])
    span = F.struct("start", "kind_no", "end")
    names = F.array(*[F.lit(k) for k in ORDER])

    def joined(spans: Column) -> Column:
        one = lambda x: F.concat_ws(":", names[x["kind_no"]], x["start"], x["end"])
        return F.array_join(F.transform(F.sort_array(spans), one), ",")

    count = lambda k: F.count(F.when(F.col("reported") & (F.col("kind_no") == ORDER.index(k)), 1))
    return spans.groupBy("row_no").agg(
        F.first("doc_id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(F.collect_list(F.when(F.col("reported") & strong, span))), 256).alias("base_sha256"),
        joined(F.collect_list(F.when(F.col("reported"), span))).alias("spans"),
        F.count(F.when(F.col("reported") & ~strong, 1)).alias("n_linked"),
    ).drop("row_no")
