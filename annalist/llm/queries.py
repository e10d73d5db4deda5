"""One thin query per operator over the given tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import bytebpe, fingerprints, kmeanstree, merkle, mixing, neardup, packing, periodic, pseudonyms, quality, toolcalls, toxicity, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_packed_sequences")
def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(pieces)


@query("op2_entropy_mix")
def entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


@query(
    "op7_url_verdicts",
    """
    WITH rules(rhost, rpath, rule, rverdict) AS (VALUES
        ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
        ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
    parts AS (
        SELECT page_id, row_number() OVER () AS n,
            translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages),
    fitting AS (
        SELECT p.*, r.rule, r.rverdict,
            row_number() OVER (PARTITION BY n ORDER BY length(r.rule) DESC NULLS LAST, r.rule) AS nth
        FROM parts p LEFT JOIN rules r
            ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
    SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM fitting WHERE nth = 1
    """,
)
def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(
        "SELECT * FROM VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow') AS t(rule, verdict)"
    )
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op6_bottom_k_fingerprints")
def bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def held_out(folds: int, fold: int) -> Column:
    """Whether crc32 of the document's number as text leaves the fold as remainder."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold


@query("op8_quality_scores")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out(4, 2)))
    scored = quality.scored(docs, model)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op10_toxicity_scores")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    scored = toxicity.scored(docs, model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The key of the registered queries. A production run passes its own.
PSEUDONYM_KEY = "a key for trials"


def _is(value: str) -> Callable[[Column], Column]:
    return lambda x: x == value


@query("op3_pseudonyms")
def linked_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    named = pseudonyms.pseudonymised(docs, PSEUDONYM_KEY, found="found")
    kinds = F.transform("found", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, _is(k))).alias(f"{k}s") for k in pseudonyms.KINDS]
    return named.select("doc_id", "text", F.transform("found", lambda x: x["pseudonym"]).alias("pseudonyms"), *counts)


@query(
    "op4_linked_calls",
    """
    WITH RECURSIVE own AS (
        SELECT conv_id, turn, 'c' || turn AS call_id, CASE WHEN turn % 4 < 2 THEN 'search' ELSE 'fetch' END AS name,
            text, length(text) AS n, count(*) AS copies
        FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY ALL),
    parts AS (
        SELECT *, CASE WHEN n % 7 = 0 THEN '"' || n % 50 || '"' ELSE (n % 50)::VARCHAR END AS lim,
            CASE WHEN n % 11 = 0 THEN NULL ELSE to_json(text)::VARCHAR END AS query
        FROM own),
    calls AS (
        SELECT *, '{"limit":' || lim || coalesce(',"query":' || query, '') || '}' AS body,
            row_number() OVER (PARTITION BY conv_id, call_id ORDER BY name, coalesce('{"query":' || query || ',', '{') || '"limit":' || lim || '}') AS nth
        FROM parts),
    depths AS (
        SELECT conv_id, turn, 0 AS depth FROM calls c
        WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
        UNION ALL
        SELECT c.conv_id, c.turn, d.depth + 1 FROM depths d JOIN calls c ON c.conv_id = d.conv_id AND c.turn = d.turn + 2 AND c.nth = 1),
    results AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth
        FROM (SELECT conv_id, turn, text, count(*) AS copies FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY ALL))
    SELECT c.conv_id, 2 * d.depth AS level, c.turn, 'call' AS kind, c.call_id,
        CASE WHEN c.nth > 1 THEN 'duplicate' WHEN EXISTS (SELECT 1 FROM results r WHERE r.conv_id = c.conv_id AND r.turn = c.turn + 1)
            THEN 'answered' ELSE 'unanswered' END AS status,
        CASE WHEN c.nth > 1 THEN '' ELSE concat_ws(', ', CASE WHEN query IS NULL THEN 'missing query' END, CASE WHEN n % 7 = 0 THEN 'type limit' END) END AS errors,
        c.copies, '{"arguments":' || body || ',"id":"' || c.call_id || '","name":"' || name || '","type":"call"}' AS json
    FROM calls c JOIN depths d ON d.conv_id = c.conv_id AND d.turn = c.turn
    UNION ALL
    SELECT r.conv_id, 2 * d.depth + 1, r.turn, 'result', 'c' || (r.turn - 1),
        CASE WHEN d.depth IS NULL THEN 'orphan' WHEN r.nth = 1 THEN 'answer' ELSE 'duplicate' END, '',
        r.copies, '{"content":' || to_json(r.text)::VARCHAR || ',"id":"c' || (r.turn - 1) || '","type":"result"}'
    FROM results r LEFT JOIN depths d ON d.conv_id = r.conv_id AND d.turn = r.turn - 1
    """,
)
def linked_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations hold no tool calls; so each user turn is read as a call
    that builds on the answer to the last one, each assistant turn as its result."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").where("text is not null")
    length = F.length("text")
    limit = F.when(length % 7 == 0, F.concat(F.lit('"'), (length % 50).cast("string"), F.lit('"'))).otherwise((length % 50).cast("string"))
    asked = F.when(length % 11 != 0, F.concat(F.regexp_replace(F.to_json(F.struct(F.col("text").alias("query"))), r"\}$", ","))).otherwise("{")
    calls = turns.where("role = 'user'").select(
        "conv_id",
        "turn",
        F.concat(F.lit("c"), "turn").alias("call_id"),
        F.when(F.col("turn") % 4 < 2, "search").otherwise("fetch").alias("name"),
        F.concat(asked, F.lit('"limit":'), limit, F.lit("}")).alias("arguments"),
        F.concat(F.lit("c"), F.col("turn") - 2).alias("after"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("c"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    schemas = spark.sql(
        "SELECT tool, field, type, required FROM VALUES ('search'), ('fetch') AS t(tool) "
        "LATERAL VIEW inline(array(struct('query', 'string', true), struct('limit', 'integer', false))) f AS field, type, required"
    )
    return toolcalls.linked(calls, results, schemas).withColumn("errors", F.array_join("errors", ", "))


@query("op5_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_tree_neighbours")
def tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeanstree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op11_byte_bpe_round_trip")
def byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bytebpe.encode(table(spark, sf_dir, "documents"), ranks_path())
    digests = encoded.select("doc_id", "ids", "starts", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"))
    decoded = bytebpe.decode(digests, ranks_path())
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def doc_crc32() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def with_planted_runs(text: Column, crc: Column) -> Column:
    """The text, or for each tenth checksum its words with a period from some
    word on. A text without words and one with a null checksum stay as they are."""
    g = F.floor(crc / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # the one-element array binds the words, so that they are cut once
    renewed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(planted(w), " "))), F.lit(0))
    return F.when(crc % 10 == 0, F.coalesce(renewed, text)).otherwise(text)


@query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_runs(F.col("text"), doc_crc32()).alias("text"))
    found = periodic.periodic_runs(docs)
    # the longest run; of several the first, then the one with the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best_of = found.withColumn("best", best)
    return best_of.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    "op13_merkle_manifest",
    """
    WITH RECURSIVE told AS (
        SELECT doc_id, source, CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS lowered, text,
            concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head
        FROM (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
                lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                    lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS crc
            FROM documents)),
    hashed AS (
        SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            sha256(head || coalesce(strlen(coalesce(lowered, text)) || ':' || coalesce(lowered, text), '-')) AS shown
        FROM told),
    leaves AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ix,
            count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
        FROM hashed),
    nodes AS (
        SELECT tree, 0 AS level, ix, n, leaf AS digest FROM leaves
        UNION ALL
        SELECT tree, level + 1, ix // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY ix))
        FROM nodes WHERE n > 1 GROUP BY tree, level, ix // 16),
    subroots AS (SELECT tree, digest AS subroot FROM nodes WHERE n = 1),
    tops AS (
        SELECT 0 AS level, tree AS ix, (SELECT count(*) FROM subroots) AS n, subroot AS digest FROM subroots
        UNION ALL
        SELECT level + 1, ix // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY ix))
        FROM tops WHERE n > 1 GROUP BY level, ix // 16),
    steps AS (
        SELECT l.tree, l.ix, x.level, string_agg(x.digest, '' ORDER BY x.ix) FILTER (x.ix < l.ix >> (4 * x.level)) AS before,
            string_agg(x.digest, '' ORDER BY x.ix) FILTER (x.ix > l.ix >> (4 * x.level)) AS after
        FROM leaves l JOIN nodes x ON x.tree = l.tree AND x.n > 1 AND x.ix // 16 = l.ix >> (4 * x.level + 4)
        GROUP BY l.tree, l.ix, x.level
        UNION ALL
        SELECT l.tree, l.ix, 1000 + x.level, string_agg(x.digest, '' ORDER BY x.ix) FILTER (x.ix < l.tree >> (4 * x.level)),
            string_agg(x.digest, '' ORDER BY x.ix) FILTER (x.ix > l.tree >> (4 * x.level))
        FROM leaves l JOIN tops x ON x.n > 1 AND x.ix // 16 = l.tree >> (4 * x.level + 4)
        GROUP BY l.tree, l.ix, x.level),
    proofs AS (
        SELECT tree, ix, list(coalesce(before, '') || '|' || coalesce(after, '') ORDER BY level) AS path FROM steps GROUP BY tree, ix),
    folded AS (
        SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, sha256(replace(array_to_string(coalesce(path, []), ''), '|', '')) AS proof_sha256,
            list_reduce(list_prepend(l.shown, coalesce(path, [])), lambda held, step: sha256(split_part(step, '|', 1) || held || split_part(step, '|', 2))) AS folded_root
        FROM leaves l JOIN subroots s USING (tree) JOIN tops t ON t.n = 1 LEFT JOIN proofs p ON p.tree = l.tree AND p.ix = l.ix)
    SELECT *, folded_root = root AS verified FROM folded
    """,
)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = merkle.leaf_digest(list((columns | {"text": lowered}).values()))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", merkle.leaf_digest(list(columns.values())).alias("leaf"), F.when(doc_crc32() % 5 == 0, tampered).alias("tampered")
    )
    held = merkle.manifest(docs, "leaf", carry=["tampered"])
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    shown = held.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return shown.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
