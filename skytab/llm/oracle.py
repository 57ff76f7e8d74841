"""SQL twins of the opN queries that SQL can express, over the whole tables."""

from __future__ import annotations

from . import mixing, quality

#: What op6 is asked for: four sources to be raised, English to be lowered, and more running prose.
MIX = mixing.Settings(
    targets={"source": {"src1": 0.1, "src3": 0.08, "src10": 0.08, "src15": 0.06}, "lang": {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.15}, "topic": {"prose": 0.8}},
    budget=0.5,
    rounds=8,
)

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"'[^\x20\x09-\x0D]+'"

OP2 = """WITH RECURSIVE good AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM good),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
comp AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.a = c.vec_id) AS n_links, component_id, component_id = vec_id AS kept FROM comp c"""

OP7 = f"""WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_AZ}) AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) r(h, f, v)),
best AS (SELECT p.page_id, p.host, p.path, arg_max(h || f, length(h || f)) AS rule, arg_max(v, length(h || f)) AS v FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM best"""

OP8 = f"""WITH lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT *, translate(trim(line, {_WS}), {_AZ}) AS key FROM lines),
often AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.last AS gone FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""

OP11 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10"""


def _quality(s: quality.Settings = quality.Settings()) -> str:
    tests = [(r, k, v, m, side) for r, (m, side, values) in enumerate(s.grids) for k, v in enumerate(values)]
    broken = lambda m, side, v: f"{m} {'>' if side == 'above' else '<'} {v!r}::DOUBLE"
    counts = " UNION ALL ".join(f"SELECT stratum, {r} AS rule, {k} AS step, {v!r}::DOUBLE AS cutoff, count(*) AS n, count(*) FILTER (WHERE {broken(m, side, v)}) AS k FROM held GROUP BY stratum" for r, k, v, m, side in tests)
    verdict = " OR ".join(f"coalesce({m} {'>' if side == 'above' else '<'} c{r}, false)" for r, (m, side, _) in enumerate(s.grids))
    cuts = ", ".join(f"max(cutoff) FILTER (WHERE rule = {r}) AS c{r}" for r in range(len(s.grids)))
    n = lambda p: f"len(regexp_extract_all(t, '{p}'))"
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END::DOUBLE"
    return rf"""WITH docs AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, {_WORD}) AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS ls FROM docs),
win AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
hit AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
base AS (SELECT w.doc_id, stratum, len(ws) AS n_words, length(t) - {n("[\\x20\\x09-\\x0D]")} AS word_chars, {n("[#*$%&|<>]")} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(ls) AS n_lines, {n("\\p{Lu}")} AS upper, {n("[!?{}|]")} AS marks FROM w LEFT JOIN hit USING (doc_id)),
m AS (SELECT *, {share("n_symbols", "word_chars")} AS symbol_share, {share("n_repeat_words", "n_words")} AS repeat_share, {share("n_dup_lines", "n_lines")} AS dup_line_share, {share("word_chars", "n_words")} AS mean_word_chars,
  {share("upper", "word_chars")} AS upper_share, {share("marks", "word_chars")} AS mark_share FROM base),
held AS (SELECT * FROM m WHERE n_words >= {s.min_words} AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
counts AS ({counts}),
level AS (SELECT {s.error!r}::DOUBLE / (count(DISTINCT stratum) * {len(s.grids)}) AS e FROM held),
asked AS (SELECT *, greatest({s.risk!r}::DOUBLE, 1 - exp(ln(e) / n)) AS r FROM counts, level),
tail AS (SELECT *, CASE WHEN r > {s.most_risk!r}::DOUBLE OR k > n * r THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(r) + (n - i) * ln(1 - r)))) END AS p FROM asked),
stop AS (SELECT stratum, rule, coalesce(min(step) FILTER (WHERE p > e * (1 + 1e-9)), 999) AS stop FROM tail GROUP BY stratum, rule),
cut AS (SELECT stratum, rule, arg_max(cutoff, step) AS cutoff FROM tail JOIN stop USING (stratum, rule) WHERE step < stop GROUP BY stratum, rule),
cuts AS (SELECT stratum, {cuts} FROM cut GROUP BY stratum),
judged AS (SELECT *, n_words < {s.min_words} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m LEFT JOIN cuts USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({verdict}) AS kept FROM judged"""


def _mixing(s: mixing.Settings = MIX) -> str:
    def share(m: str) -> str:
        """What a value of a margin weighs, before it is scaled: given shares, and what is left in proportion to the tokens."""
        given = s.targets.get(m, {})
        if not given:
            return f"pow(v, {dict(s.flatten)[m]!r}::DOUBLE) / sum(pow(v, {dict(s.flatten)[m]!r}::DOUBLE)) OVER ()"
        names = ", ".join(f"'{k}'" for k in given)
        found = f"sum(CASE {' '.join(f"WHEN {m} = '{k}' THEN {v!r}::DOUBLE" for k, v in given.items())} ELSE 0 END) OVER ()"
        rest = f"sum(CASE WHEN {m} NOT IN ({names}) THEN v END) OVER ()"
        own = f"CASE {' '.join(f"WHEN {m} = '{k}' THEN {v!r}::DOUBLE" for k, v in given.items())} END"
        return f"CASE WHEN {m} IN ({names}) THEN {own} / CASE WHEN {rest} IS NULL THEN {found} ELSE 1 END ELSE (1 - {found}) * v / {rest} END"

    targets = "".join(f", t_{m} AS (SELECT {m}, ({share(m)}) * (SELECT sum(tokens) FROM cells) AS target FROM (SELECT {m}, sum(tokens)::DOUBLE AS v FROM cells GROUP BY {m}))" for m in mixing.MARGINS)
    steps, last = "", "f0"
    for k in range(s.rounds):
        for m in mixing.MARGINS:
            name = f"f{k}_{m}"
            steps += f", {name} AS (SELECT c.source, c.lang, c.topic, c.tokens, c.weight * t.target / sum(c.weight) OVER (PARTITION BY c.{m}) AS weight FROM {last} c JOIN t_{m} t USING ({m}))"
            last = name
    off = ", ".join(f"(SELECT max(abs(w / target - 1)) FROM (SELECT {m}, sum(weight) AS w FROM {last} GROUP BY {m}) JOIN t_{m} USING ({m}))" for m in mixing.MARGINS)
    n = lambda p: f"len(regexp_extract_all(t, '{p}'))"
    return rf"""WITH docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
rows AS (SELECT doc_id, source, lang, greatest(len(regexp_extract_all(t, {_WORD})), 1) AS tokens, CASE WHEN length(t) = 0 THEN 'none' WHEN {n(" \\| ")} / length(t) > 0.01 THEN 'table' WHEN {n("[#*$%&<>]")} / length(t) > 0.05 THEN 'marked'
  WHEN {n("\\p{Lu}")} / length(t) > 0.3 THEN 'shouted' WHEN {n("\\n")} / length(t) > 0.02 THEN 'list' WHEN length(t) < 400 THEN 'brief' ELSE 'prose' END AS topic FROM docs),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM rows GROUP BY ALL){targets}, f0 AS (SELECT *, tokens::DOUBLE AS weight FROM cells){steps},
run AS (SELECT *, weight / tokens AS ratio, sum(tokens) OVER w - tokens AS ct, sum(weight) OVER w - weight AS cw FROM {last} WINDOW w AS (ORDER BY weight / tokens DESC, source, lang, topic ROWS UNBOUNDED PRECEDING)),
c AS (SELECT arg_max(({s.budget!r}::DOUBLE * (SELECT sum(tokens) FROM cells) - ct) / ((SELECT sum(weight) FROM run) - cw), ratio) AS c FROM run WHERE ({s.budget!r}::DOUBLE * (SELECT sum(tokens) FROM cells) - ct) / ((SELECT sum(weight) FROM run) - cw) * ratio <= 1)
SELECT r.doc_id, r.source, r.lang, r.topic, r.tokens, round(ratio, 6) AS weight, round(least(1.0, c * ratio), 6) AS probability, round(greatest({off}), 4) AS margin_error, ('0x' || substr(md5('{s.seed}:' || r.doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < least(1.0, c * ratio) AS selected
FROM rows r JOIN run USING (source, lang, topic), c"""


ORACLE_SQL = {"op2_embedding_near_dedup": OP2, "op6_source_mixing": _mixing(), "op7_url_filter": OP7, "op8_line_dedup": OP8, "op10_quality_rules": _quality(), "op11_hard_negatives": OP11}
