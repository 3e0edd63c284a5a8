"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, importance, labelled, media, minhash, phrases, pieces, pitman_yor, quality, runtime, sharding, suffixes, topk, toxicity


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(runtime.read(spark, sf_dir, "documents"), runtime.read(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(runtime.read(spark, sf_dir, "documents"), 8)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(runtime.read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "bits")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(runtime.read(spark, sf_dir, "documents"), runtime.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(runtime.read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(runtime.read(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", "n_unknown", "n_bytes", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "lossless")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(runtime.read(spark, sf_dir, "documents"), 85)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(runtime.read(spark, sf_dir, "documents"), labelled.held_out_rule(7, 2))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(runtime.read(spark, sf_dir, "documents"), runtime.read(spark, sf_dir, "labels"))


def op10_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.repeats(runtime.read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(runtime.read(spark, sf_dir, "documents"), runtime.read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations.repair(conversations.damage(runtime.read(spark, sf_dir, "conversations")))
    lines = F.transform(F.flatten(F.transform("parts", lambda p: p["turns"])), lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(runtime.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_sharding, op3_media, op4_decontamination, op5_suffix_dedup, op6_sentencepiece, op7_minhash, op8_lm_scoring, op9_toxicity, op10_phrase_dedup, op11_importance, op12_conversations, op13_top_k, pipeline)}


def _draw(key: str, node: str, weight: float) -> str:
    return f"(-ln((('0x' || substr(md5({key} || '/{node}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / {weight!r})"


def _least(options: list[tuple[str, str]]) -> str:
    if len(options) == 1:
        return options[0][1]
    times = [t for t, _ in options]
    cases = " ".join(f"WHEN {t} <= least({', '.join(times)}) THEN {v}" for t, v in options)
    return f"CASE {cases} END"


def _place(key: str, shards: int) -> str:
    tree: dict[str, dict[str, list[sharding.Leaf]]] = {}
    for x in sharding.topology(shards):
        tree.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    weight = lambda leaves: sum(x.weight for x in leaves)
    regions = []
    for region, racks in tree.items():
        inner = [(_draw(key, f"rack:{rack}", weight(leaves)), _least([(_draw(key, f"shard:{x.shard}", x.weight), str(x.shard)) for x in leaves])) for rack, leaves in racks.items()]
        regions.append((_draw(key, f"region:{region}", sum(weight(x) for x in racks.values())), _least(inner)))
    return _least(regions)


#: CRC-32 byte by byte: the table by rule, then a fold over the bytes.
_CRC_TABLE = "tab AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) ORDER BY i) AS t FROM range(0, 256) r(i))"


def _crc(blob: str) -> str:
    """Unsigned crc32 of a blob, beside the table t of ``tab``."""
    return f"xor(list_reduce(list_transform(range(1, octet_length({blob})::BIGINT + 1), lambda i: ('0x' || substr(hex({blob}), 2 * i - 1, 2))::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that SQL can express."""
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    out = {}
    out["op4_decontamination"] = f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)"""
    plain = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    out["op10_phrase_dedup"] = f"""
WITH d AS (SELECT doc_id, {plain} AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (h) WHERE doc_id > m) GROUP BY doc_id),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
gp AS (SELECT doc_id, unnest(ps) AS p, true AS g FROM gone),
kept AS (SELECT f.doc_id, string_agg(word, ' ' ORDER BY f.p) AS t FROM flat f LEFT JOIN gp USING (doc_id, p) WHERE g IS NULL GROUP BY f.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""
    low = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    out["op7_minhash"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {low} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS r FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r),
least_ AS (SELECT doc_id, min(r) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_ USING (doc_id)"""
    key = "coalesce(doc_id::VARCHAR, 'null')"
    out["op2_sharding"] = f"""
WITH {_CRC_TABLE},
raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
crc AS (
  SELECT doc_id, octet_length(b) + 1 AS size,
    {_crc("b")} AS text_crc32
  FROM raw, tab),
placed AS (SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, ({_place(key, 8)})::INTEGER AS shard, ({_place(key, 9)})::INTEGER AS grown_shard,
  ('0x' || substr(md5({key} || '/slot'), 1, 3))::BIGINT AS part FROM crc)
SELECT doc_id, size, text_crc32, law, shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM placed"""
    out["op11_importance"] = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT {words} AS w FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY ALL),
own AS (SELECT w, {_crc("encode(w)")} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), tab),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN own USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bw JOIN own USING (w) GROUP BY bucket),
whole AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (whole.s + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (whole.t + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), whole),
sums AS (SELECT doc_id, sum(n * gain)::BIGINT AS total, sum(n)::BIGINT AS n FROM dw JOIN own USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
weighed AS (SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight FROM d LEFT JOIN sums USING (doc_id)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS score FROM weighed),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN able USING (doc_id)"""
    out["op12_conversations"] = _repair_sql()
    out["op13_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""
    return out


def _repair_sql() -> str:
    """The same edits, with insertions tried before each turn and at the end, turn by turn on rows that aren't put together."""
    plus = lambda x, cost, letter: f"{{'c': {x}.c + {cost}, 'a': {x}.a || {letter}}}"
    struct = lambda *s: "{" + ", ".join(f"'s{k}': {x}" for k, x in enumerate(s)) + "}"
    let = lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    zero = struct(*[f"{{'c': {0 if k == 0 else 1 << 50}::BIGINT, 'a': ''}}" for k in range(4)])
    user = f"least(s.s2, {plus('s.s0', 3, "'I'")}, {plus('s.s1', 3, "'I'")}, {plus('s.s3', 3, "'I'")})"
    inserted = lambda body: let(user, "u", let(struct("s.s0", "s.s1", "u", f"least(s.s3, {plus('u', 3, "'I'")})"), "i", body))
    gone = [plus(f"i.s{k}", 4, "'D'") for k in range(4)]
    more = "(CASE x.fault WHEN 'truncated' THEN 3 ELSE 0 END)"
    turned = lambda k, initial: plus(f"i.s{k}", f"{more} + (CASE x.initial WHEN '{initial}' THEN 0 ELSE 3 END)", f"(CASE x.initial WHEN '{initial}' THEN 'K' ELSE 'R' END)")
    opened = f"CASE x.initial WHEN 's' THEN least({gone[1]}, {plus('i.s0', more, "'K'")}) ELSE {gone[1]} END"
    kept = struct(gone[0], opened, f"least({gone[2]}, {turned(0, 'u')}, {turned(1, 'u')}, {turned(3, 'u')})", f"least({gone[3]}, {turned(2, 'a')})")
    step = inserted(f"CASE WHEN x.fault IN ('blank', 'duplicate') THEN {struct(*gone)} ELSE {kept} END")
    turn = "(CASE s.state WHEN 2 THEN 'assistant' ELSE 'user' END)"
    line = f"CASE x WHEN 'I' THEN {turn} || ':' WHEN 'R' THEN {turn} || ':' || turns[s.at].text ELSE turns[s.at].role || ':' || turns[s.at].text END"
    initial = f"(CASE x WHEN 'K' THEN turns[s.at].initial ELSE {turn}[1] END)"
    after = f"CASE WHEN x = 'D' THEN s.state WHEN {initial} = 's' THEN 1 WHEN {initial} = 'u' THEN 2 ELSE 3 END"
    made = f"{{'state': {after}, 'at': CASE x WHEN 'I' THEN s.at ELSE s.at + 1 END, 'out': CASE x WHEN 'D' THEN s.out ELSE list_append(s.out, {line}) END}}"
    return rf"""
WITH {_CRC_TABLE},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS key FROM conversations),
kinds AS (SELECT *, {_crc("key")} % 20 AS kind FROM raw, tab),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
numbered AS (
  SELECT *, role[1] AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
flagged AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
convs AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, (count(*) FILTER (fault = 'blank'))::BIGINT AS blank, (count(*) FILTER (fault = 'duplicate'))::BIGINT AS duplicate,
    (count(*) FILTER (fault = 'truncated'))::BIGINT AS truncated, (count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')))::BIGINT AS illegal,
    list({{'role': role, 'text': text, 'initial': initial, 'fault': fault}} ORDER BY i) AS turns
  FROM flagged GROUP BY conv_id),
folded AS (SELECT *, list_reduce(turns, lambda s, x: {step}, {zero}) AS s FROM convs),
closed AS (SELECT * EXCLUDE (s), {inserted("least(i.s0, i.s3)")} AS best FROM folded),
made AS (SELECT *, list_reduce(list_filter(string_split(best.a, ''), lambda c: c <> ''), lambda s, x: {made}, {{'state': 0, 'at': 1, 'out': []::VARCHAR[]}}).out AS lines FROM closed)
SELECT DISTINCT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM conversations c LEFT JOIN made ON made.conv_id IS NOT DISTINCT FROM c.conv_id"""
