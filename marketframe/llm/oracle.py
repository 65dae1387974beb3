"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from marketframe.llm import mixing, secrets


def secrets_sql() -> str:
    """Secret scan: matches by kind, then the nearest complements by window."""
    q = lambda s: s.replace("'", "''")
    mixed = "regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]')"
    scans = []
    for no, (kind, (pattern, group, least, _, _)) in enumerate(secrets.KINDS.items()):
        ok = f"length(c) >= {least}" + (f" AND {mixed}" if kind == "weak_secret" else "")
        scans.append(f"""
    SELECT row_no, {no} AS kind_no, nth, w, {ok} AS ok, length(g) AS gap FROM (
      SELECT row_no, unnest(regexp_extract_all(body, '{q(pattern)}', 0)) AS w, unnest(regexp_extract_all(body, '{q(pattern)}', {group})) AS c,
        unnest(string_split_regex(body, '{q(pattern)}')) AS g, unnest(range(length(body) + 1)) AS nth
      FROM docs WHERE regexp_matches(body, '{q(pattern)}')) WHERE w IS NOT NULL""")
    kinds = lambda test: ", ".join(str(i) for i, v in enumerate(secrets.KINDS.values()) if test(v))
    strong = f"kind_no IN ({kinds(lambda v: v[4])})"

    def near(role: str) -> str:
        here = f"CASE WHEN kind_no IN ({kinds(lambda v: v[3] == role)}) THEN"
        return (f"coalesce(start - max({here} stop END) OVER before <= {secrets.SCOPE}, false) OR "
                f"coalesce(min({here} start END) OVER after - stop <= {secrets.SCOPE}, false)")

    order = "PARTITION BY row_no, ok ORDER BY start{0}, kind_no{0}, stop{0} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    windows = f"WINDOW before AS ({order.format('')}), after AS ({order.format(' DESC')})"
    name = "['" + "', '".join(secrets.KINDS) + "'][kind_no + 1] || ':' || start || ':' || stop"
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS body FROM documents),
  scans AS ({' UNION ALL '.join(scans)}),
  ends AS (SELECT row_no, kind_no, w, ok, sum(gap + length(w)) OVER (PARTITION BY row_no, kind_no ORDER BY nth) AS stop FROM scans),
  parts AS (SELECT row_no, kind_no, ok, stop - length(w) AS start, stop FROM ends),
  bounds AS (SELECT *, max(stop) OVER before AS past, min(CASE WHEN {strong} THEN start END) OVER after AS strong_next FROM parts {windows}),
  free AS (SELECT row_no, kind_no, start, stop, ok AND ({strong} OR (coalesce(past, 0) <= start AND stop <= coalesce(strong_next, stop))) AS ok FROM bounds),
  near AS (SELECT *, {near(secrets.IDENTIFIER)} AS near_id, {near(secrets.SECRET)} AS near_secret, {near(secrets.ENDPOINT)} AS near_end FROM free {windows}),
  reported AS (SELECT * FROM near WHERE ok AND ({strong} OR CASE WHEN kind_no IN ({kinds(lambda v: v[3] == secrets.SECRET)}) THEN near_id OR near_end ELSE near_secret END))
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
  sha256(coalesce(string_agg({name}, ',' ORDER BY start, kind_no) FILTER ({strong}), '')) AS base_sha256,
  coalesce(string_agg({name}, ',' ORDER BY start, kind_no) FILTER (kind_no IS NOT NULL), '') AS spans, count(*) FILTER (NOT {strong}) AS n_linked
FROM docs LEFT JOIN reported USING (row_no) GROUP BY row_no
"""


def mixing_sql() -> str:
    """Source mix: targets by raising a common level, then one running sum over each source's keys."""
    marks = mixing.MARKS.replace("'", "''")
    cycle = ", ".join(f"{w}.0" for w in mixing.CYCLE)
    return f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
  marked AS (SELECT doc_id, source, len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) AS size,
    md5(concat_ws('|', '42', coalesce(CAST(doc_id AS VARCHAR), ''), md5(body))) AS digest,
    CASE WHEN length(body) > 0 THEN CAST(length(body) - length(translate(body, '{marks}', '')) AS DOUBLE) / length(body) ELSE 0.0::DOUBLE END AS share FROM docs),
  keyed AS (SELECT doc_id, source, size, -ln((CAST('0x' || substr(digest, 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
    / greatest(0.1::DOUBLE, 1.0::DOUBLE - 3.0::DOUBLE * share) AS k FROM marked),
  sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
  weighed AS (SELECT source, source_size, [{cycle}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.CYCLE)} + 1)::INT]::DOUBLE AS w,
    source_size * {mixing.MOST_EPOCHS}::DOUBLE AS bound FROM sizes),
  prefix AS (SELECT *, bound / w AS reach, sum(w) OVER () AS all_w, sum(source_size) OVER () * {mixing.SHARE}::DOUBLE AS total,
    coalesce(sum(w) OVER before, 0) AS w_before, coalesce(sum(bound) OVER before, 0) AS bound_before FROM weighed
    WINDOW before AS (ORDER BY bound / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  levels AS (SELECT *, max(CASE WHEN (total - bound_before) / (all_w - w_before) <= reach THEN (total - bound_before) / (all_w - w_before) END) OVER () AS level FROM prefix),
  targets AS (SELECT source, source_size, CASE WHEN level IS NULL OR reach <= level THEN bound ELSE level * w END AS target FROM levels),
  plan AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {int(mixing.MOST_EPOCHS)})::BIGINT ELSE 0 END AS epochs FROM targets),
  rests AS (SELECT *, target - epochs * source_size AS rest FROM plan),
  sums AS (SELECT k.doc_id, k.size, k.source, p.source_size, p.target, p.epochs, p.rest, row_number() OVER by_key AS place,
    sum(k.size) OVER (by_key ROWS UNBOUNDED PRECEDING) - k.size / 2 <= p.rest AND p.rest > 0 AS fits
    FROM keyed k JOIN rests p ON k.source IS NOT DISTINCT FROM p.source
    WINDOW by_key AS (PARTITION BY k.source ORDER BY k.k)),
  ends AS (SELECT *, epochs + CASE WHEN place <= max(CASE WHEN fits THEN place END) OVER (PARTITION BY source) THEN 1 ELSE 0 END AS times FROM sums)
SELECT doc_id, size::BIGINT AS size, source_size, target, times * size AS taken, times FROM ends
"""


ORACLE = {
    "op4_mixing": mixing_sql(),
    "op1_secrets": secrets_sql(),
}

ORACLE["op13_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""

ORACLE["op12_phrases"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), listed AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces
), placed AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS pos FROM listed
), grams AS (
  SELECT lang, size, array_to_string(list_slice(words, pos, pos + size - 1), ' ') AS phrase
  FROM placed, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE pos + size - 1 <= len(words)
), counts AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE size > 1 AND f >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.words, 1, k), ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.words, k + 1, c.size), ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(list_slice(words, pos, pos + n - 1), ' ') AS phrase, max(a) AS around
  FROM (SELECT *, unnest(range(1, size)) AS pos FROM candidates), (SELECT unnest([2, 3]) AS n)
  WHERE n < size AND pos + n - 1 <= size GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM cuts LEFT JOIN inside USING (lang, phrase) JOIN totals USING (lang)
WHERE NOT coalesce(100::HUGEINT * around >= 80::HUGEINT * a, false)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
