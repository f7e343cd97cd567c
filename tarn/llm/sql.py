"""DuckDB SQL that gives the rows of the operators' queries."""

from __future__ import annotations

#: Operator 3. Counts in list functions and windows; the prior as one row.
HOST_RULES = r"""
WITH words AS (
  SELECT rowid_ AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)
), windows AS (
  SELECT r, i, w[i] || chr(0) || w[i+1] || chr(0) || w[i+2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1
), repeated AS (
  SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS v(d) GROUP BY r
), lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM words
), dup AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), scored AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM words LEFT JOIN repeated USING (r) LEFT JOIN dup USING (r)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM scored
), hosts AS (
  SELECT source, count(*) AS n,
         sum((base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines)::INT) AS x
  FROM failed WHERE source IS NOT NULL GROUP BY source
), prior AS (
  SELECT sum(x) / sum(n) AS m, count(*) AS k, sum(x) AS x, sum(x * x / n) AS xx, sum(n) - sum(n::DOUBLE * n) / sum(n) AS unlike_ FROM hosts
), strength AS (
  SELECT m, m * (1 - m) AS spread, CASE WHEN unlike_ > 0 THEN (xx - x * m - (k - 1) * m * (1 - m)) / unlike_ ELSE 0 END AS between_ FROM prior
), verdicts AS (
  SELECT source, CASE WHEN spread = 0 OR between_ <= 0 THEN m
                      ELSE (x + m * greatest(spread / between_ - 1, 0.0)) / (n + greatest(spread / between_ - 1, 0.0)) END AS host_rate
  FROM hosts, strength
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_rate > 0.5, false) AS kept,
       round(host_rate, 9) AS host_rate
FROM failed LEFT JOIN verdicts USING (source)
"""



#: Levels that the SQL has; the operator has no limit. The test tables' paths have three segments at most.
LEVELS = 6


def _url_templates() -> str:
    """Operator 4: one block of queries for each level of the tree."""
    from tarn.llm import urls as u

    rules = sorted(u.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", h + p, v) for h, p, v in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"
    parts = [
        rf"""WITH urls AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{u.HOST}', 1), '{u.UPPER}', '{u.LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '{u.PATH}', 1) AS path FROM pages
), general AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '\b[0-9a-f]*[0-9][0-9a-f]{{7,}}\b', '{{h}}', 'g'), '[0-9]+', '{{n}}', 'g'), '/+', '/', 'g'), '^/|/$', '', 'g') AS general FROM urls
), known AS (
  SELECT doc_id AS page_id, coalesce(max((quality = 0 OR toxic = 1)::INT), 0) AS bad FROM labels GROUP BY doc_id
), t0 AS (
  SELECT host, general, count(bad) AS labelled, coalesce(sum(bad), 0)::BIGINT AS bad, '' AS template
  FROM general LEFT JOIN known USING (page_id) GROUP BY host, general
)"""
    ]
    def unlike(n: str, bad: str, all_n: str, all_bad: str) -> str:
        n, bad, all_n, all_bad = (f"{x}::DOUBLE" for x in (n, bad, all_n, all_bad))
        apart = f"({bad} * {all_n} - {all_bad} * {n})"
        return f"({n} >= {u.LABELS} AND {all_n} - {n} >= {u.LABELS} AND {apart} * {apart} * {all_n} > {u.Z * u.Z!r}::DOUBLE * {n} * ({all_n} - {n}) * {all_bad} * ({all_n} - {all_bad}))"

    for k in range(LEVELS):
        parts.append(f"""s{k} AS MATERIALIZED (SELECT *, string_split(general, '/') AS parts, coalesce(string_split(general, '/')[{k + 1}], '') AS segment FROM t{k}),
n{k} AS MATERIALIZED (
  SELECT host, template, count(*) AS paths, max(len(parts)) AS deepest, min(segment) = max(segment) AS single, sum(labelled) AS all_n, sum(bad) AS all_bad,
         count(*) > 1 AND max(len(parts)) > {k} AND sum(labelled) >= {2 * u.LABELS} AS open FROM s{k} GROUP BY host, template
), d{k} AS (
  SELECT host, general, labelled, bad, CASE WHEN deepest <= {k} THEN template WHEN paths = 1 THEN template || '/' || array_to_string(parts[{k + 1}:], '/') ELSE template || '/**' END AS template
  FROM s{k} JOIN n{k} USING (host, template) WHERE NOT open
), b{k} AS MATERIALIZED (
  SELECT host, template, segment, sum(labelled) AS labelled, sum(bad) AS bad, any_value(all_n) AS all_n, any_value(all_bad) AS all_bad, any_value(single) AS single
  FROM s{k} JOIN n{k} USING (host, template) WHERE open GROUP BY host, template, segment
), e{k} AS MATERIALIZED (
  SELECT *, CASE WHEN {unlike('labelled', 'bad', 'all_n', 'all_bad')} THEN CASE WHEN bad * all_n > all_bad * labelled THEN '-' ELSE '+' END END AS side FROM b{k}
), o{k} AS (
  SELECT host, template, side, count(*) AS members, sum(labelled) AS pool_n, sum(bad) AS pool_bad FROM e{k} WHERE side IS NOT NULL GROUP BY host, template, side
), m{k} AS MATERIALIZED (
  SELECT host, template, segment, template || '/' || CASE WHEN side IS NULL AND single OR side IS NOT NULL AND (members = 1 OR {unlike('labelled', 'bad', 'pool_n', 'pool_bad')}) THEN segment ELSE '*' || coalesce(side, '') END AS next
  FROM e{k} LEFT JOIN o{k} USING (host, template, side)
), t{k + 1} AS MATERIALIZED (SELECT s.host, s.general, s.labelled, s.bad, m.next AS template FROM s{k} s JOIN m{k} m USING (host, template, segment))""")
    parts.append("tree AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(LEVELS)) + ")")
    parts.append(f"""prior AS (SELECT 1 - (sum(bad)::DOUBLE + 0.5::DOUBLE) / (sum(labelled)::DOUBLE + 1.0::DOUBLE) AS good FROM tree),
pure AS (
  SELECT host, template, (sum(labelled)::DOUBLE - sum(bad)::DOUBLE + {u.STRENGTH}::DOUBLE * any_value(good)) / (sum(labelled)::DOUBLE + {u.STRENGTH}::DOUBLE) AS purity
  FROM tree, prior GROUP BY host, template
)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN purity < {u.PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 9) AS purity
FROM general JOIN tree USING (host, general) JOIN pure USING (host, template)""")
    return ",\n".join(parts)


#: Operator 8: all windows of 400 bytes, and of 51 words.
RADIX_REPEATS = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, p, md5(array_slice(b, p, p + 399)) AS d FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS p FROM docs)
), starts AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY d) AS c FROM windows) WHERE c > 1
), steps AS (
  SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before, lead(p) OVER (PARTITION BY r ORDER BY p) AS after FROM starts
), removed AS (
  SELECT r, sum(least(400, coalesce(after - p, 400)))::BIGINT AS n_removed, count(*) FILTER (before IS NULL OR p > before + 400)::BIGINT AS n_spans FROM steps GROUP BY r
), kept AS (
  SELECT r, string_agg(piece, '' ORDER BY p) AS pieces FROM (
    SELECT r, 0 AS p, hex(array_slice(b, 1, coalesce(first - 1, octet_length(b)))) AS piece FROM docs LEFT JOIN (SELECT r, min(p) AS first FROM starts GROUP BY r) USING (r)
    UNION ALL
    SELECT r, p, hex(array_slice(b, p + 400, coalesce(after - 1, octet_length(b)))) FROM steps JOIN docs USING (r) WHERE coalesce(after, octet_length(b) + 1) > p + 400
  ) GROUP BY r
), word_windows AS (
  SELECT r, p, md5(array_to_string(w[p:p + 50], ' ')) AS d FROM (SELECT r, w, unnest(range(1, len(w) - 49)) AS p FROM docs)
), word_starts AS (
  SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS after FROM (SELECT r, p, count(*) OVER (PARTITION BY d) AS c FROM word_windows) WHERE c > 1
), words AS (
  SELECT r, sum(least(51, coalesce(after - p, 51)))::BIGINT AS n_repeat_words FROM word_starts GROUP BY r
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(pieces)) AS kept_sha256,
       coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
FROM docs JOIN kept USING (r) LEFT JOIN removed USING (r) LEFT JOIN words USING (r)
"""


def _secret_ownership() -> str:
    """Operator 5: places from the lengths of matches and of the gaps between them."""
    from tarn.llm import secrets as s

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    kinds = " UNION ALL ".join(
        f"SELECT r, {rank} AS rank, generate_subscripts(h, 1) AS i, unnest(h) AS hit, unnest(g[:len(h)]) AS gap "
        f"FROM (SELECT r, regexp_extract_all(text, {quoted(pattern)}) AS h, string_split_regex(text, {quoted(pattern)}) AS g FROM docs)"
        for rank, (_, pattern, _, _) in enumerate(s.KINDS)
    )
    value = f"CASE WHEN rank = 0 THEN regexp_extract(hit, {quoted(s.KINDS[0][1])}, {s.KINDS[0][2]}) ELSE hit END"
    good = " OR ".join(f"(rank = {rank} AND regexp_matches(value, {quoted(must)}){' AND regexp_matches(value, ' + quoted('[0-9].*[0-9]') + ')' if rank == s.BASE else ''})" for rank, (_, _, _, must) in enumerate(s.KINDS))
    names = "[" + ", ".join(quoted(k) for k, *_ in s.KINDS) + "]"
    shown = f"{names}[rank + 1] || ':' || start || ':' || stop"
    counts = ", ".join(f"(count(*) FILTER (rank = {rank}))::BIGINT AS n_{kind}" for rank, (kind, *_) in enumerate(s.KINDS[: s.BASE]))
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, chr(0)) AS owner, concat_ws('/', source, lang) AS repository FROM documents
), hits AS ({kinds}
), placed AS (
  SELECT r, rank, (sum(length(gap) + length(hit)) OVER (PARTITION BY r, rank ORDER BY i))::BIGINT AS stop, length(hit) AS size, {value} AS value FROM hits
), spans AS (SELECT r, rank, stop - size AS start, stop, value FROM placed WHERE {good}
), base AS (SELECT * FROM spans WHERE rank < {s.BASE}
), more AS (
  SELECT * FROM spans k WHERE rank = {s.BASE} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = k.r AND b.start < k.stop AND k.start < b.stop)
), found AS (SELECT * FROM base UNION ALL SELECT * FROM more
), owners AS (
  SELECT value, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, repository)) AS n_repositories FROM found JOIN docs USING (r) GROUP BY value
), judged AS (
  SELECT f.*, n_owners >= {s.WIDE} OR n_owners >= 2 AND n_repositories >= {s.WIDE_REPOSITORIES} AS wide FROM found f JOIN owners USING (value)
), kept AS (
  SELECT r, string_agg({shown}, ',' ORDER BY start, rank) AS spans, (count(*) FILTER (NOT wide))::BIGINT AS n_live, (count(*) FILTER (wide))::BIGINT AS n_example
  FROM judged WHERE rank < {s.BASE} OR NOT wide GROUP BY r
), counted AS (
  SELECT r, {counts}, string_agg({shown}, ',' ORDER BY start, rank) AS shown FROM base GROUP BY r
)
SELECT doc_id, {', '.join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in s.KINDS[: s.BASE])}, sha256(coalesce(shown, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN counted USING (r) LEFT JOIN kept USING (r)"""


#: Operator 11. Every word of every pair, as whole numbers of 128 bits.
SOURCE_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS MATERIALIZED (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), cells AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), totals AS (
  SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source
), grouped AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(t.total, 0)::HUGEINT AS total, coalesce(l.v, 0)::HUGEINT AS v, coalesce(l.total, 0)::HUGEINT AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN totals t USING (lang, source) LEFT JOIN langs l USING (lang)
), shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (g.lang_total + 5 * g.v) AS q
  FROM grouped g JOIN kept k ON k.lang = g.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def _vector_codes(rounds: int = 6) -> str:
    """Operator 12: a step of Lloyd's iteration as three queries, distances of all parts to all entries."""
    steps = []
    for k in range(rounds + 1):
        # Nearest entries of all parts; a tie goes to the lower index.
        steps.append(f"""d{k} AS MATERIALIZED (
  SELECT r, part, arg_min(entry, (distance, entry)) AS entry, min(distance) AS distance
  FROM (SELECT x.r, x.part, b.entry, sum((x.x - b.x) * (x.x - b.x)) AS distance FROM parts x JOIN b{k} b USING (part, i) GROUP BY x.r, x.part, b.entry) GROUP BY r, part
)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.i, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT part, entry, i, (sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM parts x JOIN d{k} USING (r, part) GROUP BY part, entry, i
  ) m ON m.part = b.part AND m.entry = b.entry AND m.i = b.i
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0 AND len(embedding) % 8 = 0
), places AS (
  SELECT r, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS place, len(embedding) // 8 AS size FROM kept
), parts AS MATERIALIZED (
  SELECT r, place // size AS part, place % size AS i, floor(x::DOUBLE * 4096)::HUGEINT AS x FROM places
), seeds AS (
  SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 16
), b0 AS MATERIALIZED (
  SELECT part, entry, i, x FROM parts JOIN seeds USING (r)
), {', '.join(steps)}, books AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM b{rounds}
), coded AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(distance) AS error FROM d{rounds} GROUP BY r
)
SELECT vec_id, code, error::BIGINT AS error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r) CROSS JOIN books
"""


ORACLES = {
    "op3_host_rules": HOST_RULES,
    "op4_url_templates": _url_templates(),
    "op5_secret_ownership": _secret_ownership(),
    "op8_radix_repeats": RADIX_REPEATS,
    "op11_source_divergence": SOURCE_DIVERGENCE,
    "op12_filtering_codes": _vector_codes(),
}
