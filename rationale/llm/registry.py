"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import nearest_neighbours
from .clusters import centroid_clusters
from .contamination import contamination_report
from .conversations import damaged_report
from .html import extract_main_text
from .jaccard import jaccard_components
from .mixing import mixed
from .packing import packed_sequences
from .quality import quality_scores
from .scoring import pseudo_likelihood
from .session import table
from .substring import substring_dedup
from .suffix import repeated_bytes
from .topk import top_inner_products


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_report(table(spark, sf_dir, "conversations"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_topk": op2_topk,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_quality": op4_quality,
        "op5_packing": op5_packing,
        "op6_mixing": op6_mixing,
        "op7_html_text": op7_html_text,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_nearest_neighbours": op9_nearest_neighbours,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_decontamination": op11_decontamination,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_centroids": op13_centroids,
    }


_WORDS = r"w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS ws FROM documents)"

OP1_SQL = f"""WITH {_WORDS.format(text="coalesce(text, '')")},
 n AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
 t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS c FROM n) WHERE c > 1),
 g AS (SELECT DISTINCT r, i + k AS p FROM t CROSS JOIN (SELECT unnest(range(0, 35)) AS k)),
 u AS (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM w),
 k AS (SELECT u.r, string_agg(x, ' ' ORDER BY u.p) AS kept, count(*) AS n FROM u LEFT JOIN g ON g.r = u.r AND g.p = u.p WHERE g.p IS NULL GROUP BY u.r)
 SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.r = w.r"""

OP2_SQL = """WITH x AS (SELECT vec_id, list_transform(embedding, lambda a: floor(256 * a::DOUBLE)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda a: a IS NULL OR NOT isfinite(a))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM x q JOIN x c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
 SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10_SQL = f"""WITH RECURSIVE {_WORDS.format(text=_FOLDED)},
 h AS (SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
 z AS (SELECT r, count(*) AS n FROM h GROUP BY r),
 o AS (SELECT a.r AS u, b.r AS v, count(*) AS c FROM h a JOIN h b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
 e AS (SELECT u, v FROM o JOIN z a ON a.r = u JOIN z b ON b.r = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
 d AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
 k AS (SELECT r, r AS c FROM w UNION SELECT k.r, d.v FROM k JOIN d ON d.u = k.c),
 m AS (SELECT k.r, min(w.doc_id) AS component_id FROM k JOIN w ON w.r = k.c GROUP BY k.r)
 SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM w LEFT JOIN z ON z.r = w.r JOIN m ON m.r = w.r"""

_PLAIN_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN_WORDS} AS ws FROM documents),
 b AS (SELECT item_id, {_PLAIN_WORDS} AS ws FROM benchmark),
 g AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
 d AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w CROSS JOIN (SELECT DISTINCT n FROM g) WHERE len(ws) >= n)),
 h AS (SELECT r, i, d.n, item_id FROM d JOIN g ON g.n = d.n AND g.s = d.s),
 p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
 t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM h WHERE item_id IS NOT NULL) GROUP BY r)
 SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM w LEFT JOIN p ON p.r = w.r LEFT JOIN t ON t.r = w.r"""


_CRC32 = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({key}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda e, z: xor(e >> 1, (e & 1) * 3988292384))), 4294967295)"


def _edit(of: str, cost: str, initial: str, text: str = "''") -> str:
    """The way ``of`` with one more edit: cost, initials and repaired text, or null."""
    return f"CASE WHEN {of} IS NOT NULL THEN {{'c': {of}.c + {cost}, 'a': {of}.a || '{initial}', 't': {of}.t || {text}}} END"


def _least(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda way: way IS NOT NULL))[1]"


_NEW_USER, _NEW_ASSISTANT = "'user:' || chr(10)", "'assistant:' || chr(10)"
_LESS = "CASE WHEN truncated THEN 3 ELSE 0 END"
_SAME_CONV = "{a}.conv_id IS NOT DISTINCT FROM {b}.conv_id"


def _kept(of: str, initial: str) -> str:
    return f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_edit(of, _LESS, 'K', 'line')} END"


def _changed(of: str, role: str) -> str:
    return f"CASE WHEN NOT gone THEN {_edit(of, f'3 + {_LESS}', 'R', f'{chr(39)}{role}:{chr(39)} || text || chr(10)')} END"


OP12_SQL = f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format(key="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
 d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 0 THEN 0 WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM k),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM d),
 t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o),
 f AS MATERIALIZED (SELECT *, last = '' AS blank, last <> '' AND nth > 1 AS duplicate, last <> '' AND nth = 1 AND last NOT IN ('.', '!', '?') AS truncated, last = '' OR nth > 1 AS gone, left(role, 1) AS initial, role || ':' || text || chr(10) AS line, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM t),
 g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
 n AS (SELECT DISTINCT conv_id FROM conversations),
 p AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS z, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS s, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS u, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS a FROM n
  UNION ALL
  SELECT q.conv_id, f.i, {_edit('z', '4', 'D')}, {_least(_edit('s', '4', 'D'), _kept('z', 's'))},
   {_least(_edit('u', '4', 'D'), *[_kept(x, 'u') for x in 'zsa'], *[_changed(x, 'user') for x in 'zsa'])},
   {_least(_edit('a', '4', 'D'), _kept('u', 'a'), _changed('u', 'assistant'))}
  FROM (SELECT conv_id, i, z, s, u, {_least('a', _edit('u', '3', 'I', _NEW_ASSISTANT))} AS a FROM (SELECT conv_id, i, z, s, a, {_least('u', *[_edit(x, '3', 'I', _NEW_USER) for x in 'zsa'])} AS u FROM p)) q JOIN f ON {_SAME_CONV.format(a='f', b='q')} AND f.i = q.i + 1),
 e AS (SELECT conv_id, {_least('z', 'a', _edit('u', '3', 'I', _NEW_ASSISTANT), _edit(f"({_edit('s', '3', 'I', _NEW_USER)})", '3', 'I', _NEW_ASSISTANT))} AS way FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM p) WHERE back = 1)
 SELECT n.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, way.c::BIGINT AS cost, way.a AS audit, sha256(left(way.t, greatest(length(way.t) - 1, 0)::BIGINT)) AS repaired_sha256
 FROM n JOIN e ON {_SAME_CONV.format(a='e', b='n')} LEFT JOIN g ON {_SAME_CONV.format(a='g', b='n')}"""


def _round_sql(i: int) -> str:
    """Assignment to the centroids c{i}, and the centroids after it."""
    return f"""d{i} AS MATERIALIZED (SELECT r, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS d FROM x CROSS JOIN c{i}),
 a{i} AS MATERIALIZED (SELECT r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS k FROM d{i}) WHERE k = 1),
 s{i} AS (SELECT c, i, sum(e)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS e FROM a{i} JOIN x ON x.r = a{i}.r) GROUP BY c, i),
 c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(l, m) AS m FROM c{i} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS l FROM s{i} GROUP BY c) z ON z.c = c{i}.c)"""


OP13_SQL = f"""WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda a: floor(64 * a::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda a: a IS NULL OR NOT isfinite(a))) = 0),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v AS m FROM (SELECT v, sha256('1:' || vec_id::VARCHAR) AS h FROM x) ORDER BY h NULLS LAST, v LIMIT 16),
 {_round_sql(0)},
 {_round_sql(1)},
 {_round_sql(2)},
 {_round_sql(3)}
 SELECT vec_id, a3.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a3.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
 FROM a3 JOIN x ON x.r = a3.r JOIN c3 ON c3.c = a3.c"""


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express at its own pace; the others are tested by brute force."""
    return {"op1_substring_dedup": OP1_SQL, "op2_topk": OP2_SQL, "op10_jaccard_join": OP10_SQL, "op11_decontamination": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_centroids": OP13_SQL}
