"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, avi, bagminhash, collocations, licenses, linededup, merkle, mixing, packing, pii, quality, suffixdedup, toxicity
from .common import table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_features(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_empirical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_media": op1_media, "op2_licenses": op2_licenses, "op3_learned_partitions": op3_learned_partitions, "op4_toxicity": op4_toxicity, "op5_pii": op5_pii, "op6_bagminhash": op6_bagminhash, "op7_packing": op7_packing, "op8_empirical_bayes": op8_empirical_bayes, "op9_mixing": op9_mixing, "op10_suffix_dedup": op10_suffix_dedup, "op11_merkle": op11_merkle, "op12_collocations": op12_collocations, "op13_line_dedup": op13_line_dedup}


_FROM, _TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))))"""

MERKLE_SQL = f"""WITH RECURSIVE tampered AS (SELECT *, n_chars + CASE WHEN {_CRC} % 7 = 0 THEN 1 ELSE 0 END AS shown_chars FROM documents),
leaves AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("shown_chars")} AS shown, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM tampered),
own(lang, h, pos, node, n) AS (SELECT lang, 0, pos, leaf, n FROM leaves
  UNION ALL SELECT lang, h + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 1) // 2 FROM own WHERE n > 1 GROUP BY lang, h, pos // 2),
subroots AS (SELECT lang, node AS subroot, h AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM own WHERE n = 1),
shared(h, pos, node, n) AS (SELECT 0, pos, subroot, n FROM subroots
  UNION ALL SELECT h + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 1) // 2 FROM shared WHERE n > 1 GROUP BY h, pos // 2),
root AS (SELECT node AS root FROM shared WHERE n = 1),
lower AS (SELECT l.doc_id, o.h AS k, (l.pos >> o.h) & 1 AS right_side, o.node AS side FROM leaves l JOIN own o ON o.lang IS NOT DISTINCT FROM l.lang AND o.n > 1 AND o.pos = xor(l.pos >> o.h, 1)),
upper AS (SELECT l.doc_id, s.height + t.h AS k, (s.pos >> t.h) & 1 AS right_side, t.node AS side FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN shared t ON t.n > 1 AND t.pos = xor(s.pos >> t.h, 1)),
sides AS (SELECT * FROM lower UNION ALL SELECT * FROM upper),
proofs AS (SELECT doc_id, sha256(string_agg(side, '' ORDER BY k)) AS proof_sha256 FROM sides GROUP BY doc_id),
tall AS (SELECT s.lang, s.height + (SELECT max(h) FROM shared) AS height FROM subroots s),
folds(doc_id, k, height, node) AS (SELECT l.doc_id, 0, t.height, l.shown FROM leaves l JOIN tall t ON t.lang IS NOT DISTINCT FROM l.lang
  UNION ALL SELECT f.doc_id, f.k + 1, f.height, sha256(CASE WHEN s.side IS NULL THEN f.node WHEN s.right_side = 1 THEN s.side || f.node ELSE f.node || s.side END)
  FROM folds f LEFT JOIN sides s ON s.doc_id = f.doc_id AND s.k = f.k WHERE f.k < f.height)
SELECT l.doc_id, l.leaf, s.subroot, r.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = r.root AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN folds f ON f.doc_id = l.doc_id AND f.k = f.height LEFT JOIN proofs p ON p.doc_id = l.doc_id, root r"""

COLLOCATIONS_SQL = rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_FROM}', '{_TO}'), '[.,;:!?
-
]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
phrases AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM phrases WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM phrases WHERE k > 1 AND f >= 100),
inner_starts AS (SELECT lang, f, k, w, unnest(range(1, k)) AS i FROM candidates),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer FROM inner_starts, (SELECT unnest(range(2, 5)) AS m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * f),
cuts AS (SELECT lang, phrase, f AS a, cut, array_to_string(w[1:cut], ' ') AS one, array_to_string(w[cut + 1:], ' ') AS two FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, cut, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM cuts c
  JOIN phrases x ON x.lang = c.lang AND x.phrase = one JOIN phrases y ON y.lang = c.lang AND y.phrase = two JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= 2000"""

LINES_SQL = f"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keys AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_FROM}', '{_TO}') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS holder FROM keys WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT k.doc_id, k.line, k.place, coalesce(f.holder < k.doc_id, false) AS gone FROM keys k LEFT JOIN firsts f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle": MERKLE_SQL, "op12_collocations": COLLOCATIONS_SQL, "op13_line_dedup": LINES_SQL}
