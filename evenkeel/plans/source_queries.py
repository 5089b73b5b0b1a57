"""Registered queries: sources, sinks, contracts and data preparation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import prepare
from ..session import cut, shared_folder
from ..sources import arrays, contracts, tables
from .fixture import BENCHMARKS, FOLD, N_ITEMS, Fixture
from .registry import query, rounded


def _folder(fx: Fixture) -> str:
    return f"{shared_folder(fx.spark)}/io-{uuid.uuid4().hex}"


@query("read_responses", """SELECT family, item_group, count(*) AS cells, sum(y)::BIGINT AS ones FROM fx_resp GROUP BY ALL""")
def read_responses(fx):
    """Round trip through parquet, CSV and JSON, read with fixed schemas."""
    path = _folder(fx)
    fx.resp.select("benchmark", "item_id", "model_id", "y").write.parquet(f"{path}/responses.parquet")
    fx.models.write.option("header", True).csv(f"{path}/models.csv")
    fx.items.write.json(f"{path}/items.json")
    back = tables.read_responses(fx.spark, f"{path}/responses.parquet", f"{path}/models.csv", f"{path}/items.json")
    return back.groupBy("family", "item_group").agg(F.count(F.lit(1)).alias("cells"), F.sum("y").cast("bigint").alias("ones"))


@query("wide_to_long", """SELECT model_id, benchmark, count(*) FILTER (y = 1) AS hits FROM fx_all GROUP BY ALL""")
def wide_to_long(fx):
    wide = fx.models.select("model_id").join(
        fx.hits.groupBy("model_id").pivot("benchmark", list(BENCHMARKS)).count(), "model_id", "left").na.fill(0)
    return tables.wide_to_long(wide, ["model_id"], BENCHMARKS, "benchmark", "hits")


@query("array_round_trip", "SELECT benchmark, item_id, model_id, y FROM fx_resp")
def array_round_trip(fx):
    """The outcome matrix, items of all benchmarks by models, written as array files and read back by ranges of rows."""
    models = cut(tables.merge_sources([fx.pop.select(F.col("model_id").cast("string").alias("name"), F.col("model_id").alias("position"))])
                 .select(F.col("name").cast("bigint").alias("model_id"), F.col("model_index").cast("int").alias("position")))
    # a cell that is not there is -1
    row = F.array_position(F.array(*map(F.lit, BENCHMARKS)), F.col("benchmark")).cast("bigint") - 1
    grid = fx.spark.range(len(BENCHMARKS) * N_ITEMS).select(F.col("id").alias("row"))
    given = (fx.resp.join(models, "model_id").groupBy((row * N_ITEMS + F.col("item_id")).alias("row"))
             .agg(F.map_from_entries(F.collect_list(F.struct("position", "y"))).alias("ys")))
    width = models.count()
    values = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.try_element_at("ys", k), F.lit(-1)))
    path = f"{_folder(fx)}/responses"
    arrays.write_npy(grid.join(given, "row", "left").select("row", values.alias("values")), path)
    cells = arrays.read_npy(fx.spark, path, partition_bytes=32_768).where("value >= 0")
    return cells.join(models, F.col("column") == F.col("position")).select(
        F.element_at(F.array(*map(F.lit, BENCHMARKS)), (F.floor(F.col("row") / N_ITEMS) + 1).cast("int")).alias("benchmark"),
        (F.col("row") % N_ITEMS).alias("item_id"), "model_id", F.col("value").cast("int").alias("y"))


@query("packed_to_long", "SELECT benchmark, item_id, model_id, y FROM fx_resp")
def packed_to_long(fx):
    named = fx.pop.select(F.col("model_id").cast("string").alias("name"), F.col("model_id").alias("position"))
    index = tables.merge_sources([named]).select(
        F.col("name").cast("bigint").alias("model_id"), F.col("model_index").cast("int").alias("position"))
    index = cut(index)
    packed = tables.pack(fx.resp, index, ["benchmark", "item_id"])
    return tables.packed_to_long(packed, index, ["benchmark", "item_id"])


@query("validate_responses", """WITH f AS (SELECT benchmark, item_id, model_id, count(*) AS c, count(*) FILTER (y NOT IN (0, 1) OR y IS NULL) AS bad FROM fx_all GROUP BY ALL)
SELECT 'not_binary' AS rule, sum(bad)::BIGINT AS violations FROM f UNION ALL SELECT 'repeated_cell', count(*) FILTER (c > 1) FROM f
UNION ALL SELECT 'missing_cell', (SELECT count(*) FROM (SELECT DISTINCT benchmark, item_id FROM f)) * (SELECT count(DISTINCT model_id) FROM f) - (SELECT count(*) FROM f)
UNION ALL SELECT 'repeated_model', count(*) - count(DISTINCT model_id) FROM fx_models
UNION ALL SELECT 'blank_model_field', count(*) FILTER (family IS NULL OR trim(family) = '' OR owner IS NULL OR model_id IS NULL) FROM fx_models
UNION ALL SELECT 'fewer_than_two_families', CASE WHEN count(DISTINCT family) < 2 THEN 1 ELSE 0 END FROM fx_models
UNION ALL SELECT 'fewer_than_four_owners', CASE WHEN count(DISTINCT owner) < 4 THEN 1 ELSE 0 END FROM fx_models
UNION ALL SELECT 'repeated_item', count(*) - count(DISTINCT item_id) FROM fx_items
UNION ALL SELECT 'blank_item_field', count(*) FILTER (item_group IS NULL) FROM fx_items""")
def validate_responses(fx):
    return contracts.validate_responses(fx.all_responses, fx.models, fx.items, ["benchmark"])


def part_layout(fx: Fixture):
    """Blocks of 25 parts, as a JSON layout file would list them."""
    block = F.floor(F.col("p_partkey") / 25)
    return fx.table("part").groupBy(F.concat(F.lit("block_"), block.cast("string")).alias("dataset_name")).agg(
        F.concat(F.lit("set_"), (F.min(block) % 4).cast("string")).alias("dataset"),
        F.min("p_partkey").alias("start"), (F.max("p_partkey") + 1).alias("stop"))


LAYOUT_SQL = """(SELECT 'block_' || (p_partkey // 25) AS dataset_name, 'set_' || (min(p_partkey // 25) % 4) AS dataset,
  min(p_partkey) AS start, max(p_partkey) + 1 AS stop FROM part GROUP BY p_partkey // 25)"""


@query("read_item_layout", """SELECT p_partkey AS item_id, 'block_' || (p_partkey // 25) AS dataset_name, 'set_' || ((p_partkey // 25) % 4) AS dataset, false AS gap FROM part""")
def read_item_layout(fx):
    path = f"{_folder(fx)}/layout.json"
    part_layout(fx).select("dataset_name", "dataset", "start", "stop").write.json(path)
    return tables.expand_layout(tables.read_table(fx.spark, path, tables.LAYOUT)).select("item_id", "dataset_name", "dataset", "gap")


RAW_NAME = """CASE c_custkey % 4 WHEN 0 THEN 'open-llm-leaderboard-old/details_' || c_name WHEN 1 THEN 'details_' || c_name
  WHEN 2 THEN c_name || '-details' ELSE c_name END"""
CLEAN_SQL = "regexp_replace(regexp_replace(replace({}, 'open-llm-leaderboard-old/', ''), '^details_', ''), '-details$', '')"


def raw_names(fx: Fixture):
    return fx.table("customer").select(F.expr(RAW_NAME).alias("name"),
                                       F.col("c_custkey").alias("position"), "c_acctbal")


@query("normalize_model_name", f"SELECT c_custkey AS position, {CLEAN_SQL.format(RAW_NAME)} AS name FROM customer")
def normalize_model_name(fx):
    return raw_names(fx).select("position", tables.normalize_model_name(F.col("name")).alias("name"))


MERGED_SQL = f"""(SELECT name, struct_extract(min(seen), 'source') AS source, struct_extract(min(seen), 'position') AS position, count(*) AS sources FROM (
  SELECT 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS name, {{'source': 0, 'position': o_custkey}} AS seen FROM (SELECT DISTINCT o_custkey FROM orders)
  UNION ALL SELECT {CLEAN_SQL.format(RAW_NAME)}, {{'source': 1, 'position': c_custkey}} FROM customer WHERE c_acctbal > 0
  UNION ALL SELECT {CLEAN_SQL.format(RAW_NAME)}, {{'source': 2, 'position': c_custkey}} FROM customer) GROUP BY name)"""


def three_sources(fx: Fixture):
    """Buyers, customers in credit and all customers: overlapping name lists with mixed spellings."""
    buyers = fx.table("orders").select(F.col("o_custkey").alias("position")).distinct().select(
        F.concat(F.lit("details_Customer#"), F.lpad(F.col("position").cast("string"), 9, "0")).alias("name"), "position")
    names = raw_names(fx)
    return [buyers, names.filter("c_acctbal > 0").drop("c_acctbal"), names.drop("c_acctbal")]


@query("merge_sources", f"""SELECT name, source, position, sources, row_number() OVER (ORDER BY source, position, name) - 1 AS model_index FROM {MERGED_SQL}""")
def merge_sources(fx):
    return tables.merge_sources(three_sources(fx))


@query("assemble_blocks", """SELECT benchmark AS dataset, count(*) AS cells, sum(y)::BIGINT AS ones, 0::BIGINT AS outside, 0::BIGINT AS unknown_models, 0::BIGINT AS overlaps
  FROM fx_all GROUP BY 1""")
def assemble_blocks(fx):
    index = tables.merge_sources(three_sources(fx))
    layout = fx.items.select(F.explode(F.array(*[
        F.struct(F.lit(b).alias("dataset"), F.lit(k * N_ITEMS).cast("bigint").alias("start"),
                 F.lit((k + 1) * N_ITEMS).cast("bigint").alias("stop")) for k, b in enumerate(BENCHMARKS)])).alias("s")).select("s.*").distinct()
    names = fx.table("customer").select(F.col("c_custkey").alias("model_id"), F.col("c_name").alias("name"))
    blocks = fx.dense(names).select(F.col("benchmark").alias("dataset"), F.col("item_id").alias("local_item"), "name", "y")
    return tables.assembly_report(blocks, layout, index)


@query("export_benchmark_slice", "SELECT benchmark, model_id, sum(y)::BIGINT AS s, count(*) AS n FROM fx_resp WHERE benchmark = 'N' GROUP BY ALL")
def export_benchmark_slice(fx):
    path = _folder(fx)
    tables.export_slice(fx.resp.select("benchmark", "item_id", "model_id", "y"), path)
    back = fx.spark.read.schema(tables.RESPONSES).parquet(path).filter("benchmark = 'N'")
    return back.groupBy("benchmark", "model_id").agg(F.sum("y").cast("bigint").alias("s"), F.count(F.lit(1)).alias("n"))


@query("item_runs", """SELECT name, min(p_partkey) AS start, max(p_partkey) + 1 AS stop, count(*) AS n_items, count(*) FILTER (prev IS NULL OR prev <> name) AS runs
  FROM (SELECT p_partkey, p_type || '/' || (p_partkey // 25) % 10 AS name, lag(p_type || '/' || (p_partkey // 25) % 10) OVER (ORDER BY p_partkey) AS prev FROM part) GROUP BY name""")
def item_runs(fx):
    name = F.concat("p_type", F.lit("/"), (F.floor(F.col("p_partkey") / 25) % 10).cast("string"))
    return tables.item_runs(fx.table("part").select("p_partkey", name.alias("name")), "name", "p_partkey")


@query("row_dataset_map", """SELECT p_partkey AS item_id, 'block_' || (p_partkey // 25) AS dataset_name FROM part""")
def row_dataset_map(fx):
    return tables.row_dataset_map(fx.table("part").select(F.col("p_partkey").alias("item_id")), part_layout(fx))


@query("dense_id_check", """SELECT 'orders' AS tab, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) - count(DISTINCT o_orderkey) AS repeats,
  max(o_orderkey) - min(o_orderkey) + 1 - count(DISTINCT o_orderkey) AS holes, min(o_orderkey) = 0 AND max(o_orderkey) = count(*) - 1 AND count(*) = count(DISTINCT o_orderkey) AS dense FROM orders
 UNION ALL SELECT 'labels', count(*), min(doc_id), max(doc_id), count(*) - count(DISTINCT doc_id), max(doc_id) - min(doc_id) + 1 - count(DISTINCT doc_id),
  min(doc_id) = 0 AND max(doc_id) = count(*) - 1 AND count(*) = count(DISTINCT doc_id) FROM labels""")
def dense_id_check(fx):
    one = lambda t, c: contracts.dense_id_check(fx.table(t), c).withColumn("tab", F.lit(t))
    return one("orders", "o_orderkey").unionByName(one("labels", "doc_id"))


@query("missing_ids", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL")
def missing_ids(fx):
    return contracts.missing_ids(fx.table("labels"), "doc_id", fx.table("documents").count())


SPARSE_SQL = """(SELECT o_custkey AS model_id, l_partkey % 200 AS item_id, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


def sparse(fx: Fixture):
    """Observed pairs only; a pair never bought is missing."""
    lines = fx.table("lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    orders = fx.table("orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("o_custkey").alias("model_id"), (F.col("l_partkey") % N_ITEMS).alias("item_id")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("y"))


@query("matrix_profile", f"""WITH c AS {SPARSE_SQL}, i AS (SELECT item_id, count(*) AS n, sum(y) AS one, avg(y) AS p, stddev_pop(y) AS sd FROM c GROUP BY 1),
 m AS (SELECT model_id, count(*) AS n FROM c GROUP BY 1)
SELECT sum(n)::BIGINT AS valid_cells, sum(one)::BIGINT AS correct_cells, sum(n - one)::BIGINT AS incorrect_cells, 0::BIGINT AS other_cells,
 min(n) AS responses_per_item_min, max(n) AS responses_per_item_max, round(min(p), 8) AS item_accuracy_min, round(median(p), 8) AS item_accuracy_median,
 round(max(p), 8) AS item_accuracy_max, count(*) FILTER (sd < 0.01) AS items_low_sd, count(*) FILTER (p <= 0.02) AS items_at_most_002,
 count(*) FILTER (p >= 0.98) AS items_at_least_098, count(*) FILTER (sd >= 0.01 AND p > 0.02 AND p < 0.98) AS items_kept,
 (SELECT min(n) FROM m) AS responses_per_model_min, (SELECT max(n) FROM m) AS responses_per_model_max,
 200 * (SELECT count(*) FROM customer) - sum(n)::BIGINT AS missing_cells, round(sum(one)::DOUBLE / sum(n), 8) AS overall_accuracy FROM i""")
def matrix_profile(fx):
    return rounded(contracts.matrix_profile(sparse(fx), N_ITEMS, fx.table("customer").count()))


@query("two_stage_item_filter", """SELECT benchmark, item_id, round(avg(y), 8) AS accuracy, round(stddev_pop(y), 8) AS sd FROM fx_all GROUP BY ALL
  HAVING stddev_pop(y) >= 0.01 AND avg(y) > 0.02 AND avg(y) < 0.98""")
def two_stage_item_filter(fx):
    return rounded(contracts.two_stage_item_filter(fx.all_responses, ["benchmark"]))


@query("complete_models", """SELECT o_custkey AS model_id FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)""")
def complete_models(fx):
    cells = fx.table("orders").select(F.col("o_custkey").alias("model_id"), F.col("o_orderpriority").alias("item_id"))
    return contracts.complete_models(cells)


ALIGN_SQL = """WITH k AS (SELECT lang, source, sha256(text) AS digest, min(doc_id) AS lo, count(*) AS n FROM documents GROUP BY ALL)
SELECT lo AS old_id, lo + 1000000000 AS new_id, CASE WHEN n > 1 THEN 'repeated_key' ELSE 'aligned' END AS status FROM k"""


def keyed_documents(fx: Fixture, shift: int = 0):
    return fx.table("documents").select(
        (F.col("doc_id") + shift).alias("id"), "lang", "source", prepare.text_digest(F.col("text")).alias("digest"))


@query("id_alignment", ALIGN_SQL)
def id_alignment(fx):
    return contracts.id_alignment(keyed_documents(fx), keyed_documents(fx, 10 ** 9), ["lang", "source", "digest"])


@query("reorder_aligned", "SELECT count(*) AS rows, 0::BIGINT AS lost, 0::BIGINT AS added FROM documents")
def reorder_aligned(fx):
    """Rewrite the records in new-id order as JSON and compare with what is read back."""
    path = f"{_folder(fx)}/records.json"
    docs = fx.table("documents").select((F.col("doc_id") + 10 ** 9).alias("new_id"), "lang", "source", "n_chars", "text")
    docs.repartitionByRange("new_id").sortWithinPartitions("new_id").write.json(path)
    back = fx.spark.read.schema(docs.schema).json(path)
    lost, added = docs.exceptAll(back), back.exceptAll(docs)
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias(n), F.lit(1).alias("_k"))
    return count(back, "rows").join(count(lost, "lost"), "_k").join(count(added, "added"), "_k").drop("_k")


PART_SCHEMA = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_brand", T.StringType())])


@query("router_item_loader", "SELECT p_brand, count(*) AS n, min(p_partkey) AS first_id, min(p_name) AS first_name FROM part GROUP BY 1")
def router_item_loader(fx):
    path = f"{_folder(fx)}/part.csv"
    fx.table("part").select("p_partkey", "p_name", "p_brand").write.option("header", True).csv(path)
    items = tables.load_items(fx.spark, path, PART_SCHEMA, "p_partkey", ["p_partkey", "p_name", "p_brand"])
    return items.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id"), F.min("p_name").alias("first_name"))


def norm_sql(t: str) -> str:
    t = f"regexp_replace({t}, '\\r\\n?', chr(10), 'g')"
    t = f"regexp_replace(regexp_replace({t}, '^\\s+|\\s+$', '', 'g'), '(^|\\n)Answer:\\s*$', '', 'g')"
    return f"regexp_replace(regexp_replace({t}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"


@query("normalize_text", f"SELECT doc_id, sha256({norm_sql('text')}) AS digest, length({norm_sql('text')})::INTEGER AS n FROM documents")
def normalize_text(fx):
    t = prepare.normalize_text(F.col("text"))
    return fx.table("documents").select("doc_id", t.alias("t")).select(
        "doc_id", F.sha2("t", 256).alias("digest"), F.length("t").alias("n"))


FOLD_SQL = "regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g')"


@query("text_digest_preview", f"""SELECT doc_id, sha256(text) AS digest, CASE WHEN length({FOLD_SQL}) <= 180 THEN {FOLD_SQL} ELSE substr({FOLD_SQL}, 1, 179) || '…' END AS preview FROM documents""")
def text_digest_preview(fx):
    return fx.table("documents").select("doc_id", prepare.text_digest(F.col("text")).alias("digest"),
                                        prepare.preview(F.col("text")).alias("preview"))


PAIR_COLS = {
    "question": "array_to_string(w[1:greatest(len(w) - 8, 0)], ' ')",
    "oa": "array_to_string(w[greatest(len(w) - 8, 0) + 1:greatest(len(w) - 8, 0) + 4], ' ')",
    "ob": "array_to_string(w[greatest(len(w) - 8, 0) + 5:], ' ')"}
PROBLEM_SQL = """CASE item_id % 4 WHEN 0 THEN '  ' || question || chr(10) || blk || chr(10) || 'Answer: ' WHEN 1 THEN question
  WHEN 2 THEN replace(question, ' the ', ' one ') || ' so' || chr(10) || blk ELSE blk || ' ' || question END"""


@query("content_match_status", f"""WITH p AS (SELECT item_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM benchmark),
 q AS (SELECT item_id, {', '.join(f'{e} AS {n}' for n, e in PAIR_COLS.items())} FROM p),
 b AS (SELECT *, 'A. ' || oa || chr(10) || 'B. ' || ob AS blk FROM q), r AS (SELECT *, {PROBLEM_SQL} AS problem FROM b),
 n AS (SELECT item_id, {norm_sql("question || chr(10) || blk")} AS t, {norm_sql('problem')} AS s, {norm_sql('blk')} AS tail FROM r)
SELECT item_id, CASE WHEN t = s THEN 'normalized_exact' WHEN ends_with(s, tail) THEN
   CASE WHEN 1.0 - levenshtein(t, s)::DOUBLE / greatest(length(t), length(s)) >= 0.75 THEN 'variant_same_options' ELSE 'no_match' END
  WHEN starts_with(t, s) OR starts_with(s, t) THEN 'prefix_variant' ELSE 'no_match' END AS status FROM n""")
def content_match_status(fx):
    t, problem = matched_texts(fx)
    return t.select("item_id", prepare.content_match_status(F.col("question"), F.col("options"), problem).alias("status"))


@query("block_match_status")
def block_match_status(fx):
    """The same pairs by matching blocks, with the similarity where the options agree."""
    t, problem = matched_texts(fx)
    found = prepare.block_match_status(F.col("question"), F.col("options"), problem)
    return rounded(t.select("item_id", found.alias("m")).select("item_id", "m.status", "m.similarity"))


def matched_texts(fx):
    """Benchmark texts as a question and two options, and a problem that says it the same or another way."""
    w = F.split(F.translate("text", "\n", " "), " ")
    cut_at = F.greatest(F.size(w) - 8, F.lit(0))
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    opts = F.array(F.struct(F.lit("A").alias("label"), F.col("oa").alias("text")), F.struct(F.lit("B").alias("label"), F.col("ob").alias("text")))
    t = fx.table("benchmark").select("item_id", part(F.lit(1), cut_at).alias("question"), part(cut_at + 1, F.lit(4)).alias("oa"), part(cut_at + 5, F.lit(4)).alias("ob"))
    t = t.withColumn("options", F.to_json(opts)).withColumn(
        "blk", F.concat(F.lit("A. "), "oa", F.lit("\nB. "), "ob"))
    problem = (F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("  "), "question", F.lit("\n"), "blk", F.lit("\nAnswer: ")))
               .when(F.col("item_id") % 4 == 1, F.col("question"))
               .when(F.col("item_id") % 4 == 2, F.concat(F.replace("question", F.lit(" the "), F.lit(" one ")), F.lit(" so\n"), "blk"))
               .otherwise(F.concat("blk", F.lit(" "), "question")))
    return t, problem


SENTENCES_SQL = """(SELECT item_id, w[1:len(w) // 2] AS a, w[len(w) // 2 + 1:] AS b, w[1] AS o1, w[len(w)] AS o2 FROM (
  SELECT item_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 4)"""
SENTENCE_SQL = "array_to_string(a, ' ') || ' _ ' || array_to_string(b, ' ') || CASE WHEN item_id % 5 = 2 THEN ' _' ELSE '' END"
SAID_SQL = """'given' || chr(10) || chr(10) || CASE item_id % 5 WHEN 0 THEN array_to_string(a, ' ') || ' ' || o1 WHEN 1 THEN array_to_string(a, ' ') || '  ' || o2
  WHEN 2 THEN array_to_string(a, ' ') || ' ' || o2 || ' ' || b[1] WHEN 3 THEN array_to_string(b, ' ') || ' ' || o1 ELSE array_to_string(a, ' ') END"""


@query("sentence_template_status", f"""WITH t AS (SELECT item_id, {SENTENCE_SQL} AS sentence, {SAID_SQL} AS question, o1, o2,
   CASE WHEN item_id % 7 = 6 THEN 'Pick one:' ELSE 'Choose the right option for a given sentence:' END AS head FROM {SENTENCES_SQL}),
 n AS (SELECT item_id, head, {norm_sql("string_split(question, chr(10) || chr(10))[-1]")} AS said, {norm_sql("split_part(sentence, '_', 1) || o1")} AS p1, {norm_sql("split_part(sentence, '_', 1) || o2")} AS p2,
   {norm_sql("replace(sentence, '_', o1)")} AS f1, {norm_sql("replace(sentence, '_', o2)")} AS f2 FROM t)
SELECT item_id, CASE WHEN head <> 'Choose the right option for a given sentence:' THEN 'other_template' WHEN said IN (p1, p2) THEN 'blank_prefix'
  WHEN starts_with(f1, said) OR starts_with(f2, said) THEN 'other_blank' ELSE 'no_match' END AS status FROM n""")
def sentence_template_status(fx):
    w = F.filter(F.split(F.translate("text", "\n", " "), " "), lambda x: x != "")
    half = F.floor(F.size("w") / 2).cast("int")
    t = fx.table("benchmark").select("item_id", w.alias("w")).where(F.size("w") >= 4).select(
        "item_id", F.array_join(F.slice("w", F.lit(1), half), " ").alias("a"), F.slice("w", half + 1, F.size("w") - half).alias("bw"),
        F.get("w", F.lit(0)).alias("o1"), F.element_at("w", -1).alias("o2")).withColumn("b", F.array_join("bw", " "))
    k = F.col("item_id") % 5
    sentence = F.concat("a", F.lit(" _ "), "b", F.when(k == 2, " _").otherwise(""))
    said = (F.when(k == 0, F.concat("a", F.lit(" "), "o1")).when(k == 1, F.concat("a", F.lit("  "), "o2"))
            .when(k == 2, F.concat("a", F.lit(" "), "o2", F.lit(" "), F.get("bw", F.lit(0)))).when(k == 3, F.concat("b", F.lit(" "), "o1")).otherwise(F.col("a")))
    head = F.when(F.col("item_id") % 7 == 6, "Pick one:\n").otherwise(prepare.SENTENCE_HEAD)
    problem = F.concat(head, sentence, F.lit("\nOption 1: "), "o1", F.lit("\nOption 2: "), "o2")
    return t.select("item_id", prepare.sentence_template_status(F.concat(F.lit("given\n\n"), said), problem, False).alias("status"))


SOURCE_SQL = """CASE WHEN source LIKE '%1' THEN 'ori_mmlu-' || source WHEN source LIKE '%2' THEN ' STEMEZ-' || source
  WHEN source LIKE '%3' THEN 'theoremQA-' || source ELSE source END"""


@query("item_features", f"""SELECT doc_id, CASE WHEN starts_with(lower(trim({SOURCE_SQL})), 'ori') THEN 'ori' WHEN starts_with(lower(trim({SOURCE_SQL})), 'stemez') THEN 'stemez'
  WHEN starts_with(lower(trim({SOURCE_SQL})), 'theoremqa') THEN 'theoremQA' ELSE 'unknown' END AS source_family, len(string_split(text, '. '))::INTEGER AS n_options,
  sha256(array_to_string(list_concat([trim(source)], list_filter(list_transform(string_split(text, '. '), lambda x: trim(x)), lambda x: x <> '')), chr(10))) AS digest FROM documents""")
def item_features(fx):
    options = F.split("text", r"\. ")
    return fx.table("documents").select(
        "doc_id", prepare.source_family(F.expr(SOURCE_SQL)).alias("source_family"), F.size(options).alias("n_options"),
        F.sha2(prepare.item_text(F.col("source"), options), 256).alias("digest"))


@query("question_text_join", """SELECT d.item_id, d.benchmark, d.status, sha256(d.text) AS digest FROM (SELECT i.p_partkey AS item_id, 'doc' AS benchmark, t.text,
  CASE WHEN t.doc_id IS NULL THEN 'missing' ELSE 'found' END AS status FROM part i LEFT JOIN documents t ON t.doc_id = i.p_partkey) d""")
def question_text_join(fx):
    items = fx.table("part").select(F.col("p_partkey").alias("item_id"), F.lit("doc").alias("benchmark"))
    texts = fx.table("documents").select(F.col("doc_id").alias("item_id"), F.lit("doc").alias("benchmark"), "text")
    return prepare.question_text_join(items, texts, ["benchmark", "item_id"]).select(
        "item_id", "benchmark", "status", F.sha2("text", 256).alias("digest"))


@query("pseudonymize", """WITH a AS (SELECT o, 'owner_' || lpad((row_number() OVER (ORDER BY o) - 1)::VARCHAR, 4, '0') AS alias FROM (SELECT DISTINCT owner::VARCHAR AS o FROM fx_models)),
 f AS (SELECT o, 'family_' || lpad((row_number() OVER (ORDER BY o) - 1)::VARCHAR, 4, '0') AS alias FROM (SELECT DISTINCT family AS o FROM fx_models))
SELECT m.model_id, a.alias AS owner, f.alias AS family FROM fx_models m JOIN a ON a.o = m.owner::VARCHAR JOIN f ON f.o = m.family""")
def pseudonymize(fx):
    t = tables.pseudonymize(fx.models, "owner", "owner")
    return tables.pseudonymize(t, "family", "family").select("model_id", "owner", "family")


@query("first_appearance_alias", """SELECT l_returnflag, l_suppkey, 'record_' || CASE WHEN rn - 1 < 1000 THEN lpad((rn - 1)::VARCHAR, 4, '0') ELSE (rn - 1)::VARCHAR END AS l_suppkey_alias, n FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY k, l_suppkey) AS rn FROM (SELECT l_returnflag, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS k, count(*) AS n FROM lineitem GROUP BY ALL))""")
def first_appearance_alias(fx):
    lines = fx.table("lineitem").select("l_returnflag", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    t = tables.first_appearance_alias(lines, ["l_returnflag"], "l_suppkey", "k", "record")
    return t.groupBy("l_returnflag", "l_suppkey", "l_suppkey_alias").agg(F.count(F.lit(1)).alias("n"))


@query("write_results", f"""SELECT 'anchors' AS tab, count(*) AS n, round(sum(weight), 6) AS total FROM fx_anchors UNION ALL
  SELECT 'scores', count(*), round(sum(low_score), 6) FROM fx_scored""")
def write_results(fx):
    path = _folder(fx)
    tables.write_results({"anchors": fx.anchors, "scores": fx.scored}, path)
    back = lambda n, c: fx.spark.read.parquet(f"{path}/{n}").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(c), 6).alias("total")).withColumn("tab", F.lit(n))
    return back("anchors", "weight").unionByName(back("scores", "low_score"))


@query("table_fingerprint", """SELECT count(*) AS rows, sum(('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)), 1, 8))::BIGINT)::BIGINT AS digest FROM orders""")
def table_fingerprint(fx):
    return contracts.table_fingerprint(fx.table("orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("table_diff", """SELECT '<rows>' AS column_name, count(*) FILTER (owner = 0) AS differing FROM fx_scored
  UNION ALL SELECT 'family', 0 UNION ALL SELECT 'owner', 0 UNION ALL SELECT 'full_score', 0
  UNION ALL SELECT 'low_score', count(*) FILTER (owner = 3) FROM fx_scored""")
def table_diff(fx):
    """A copy that lost one owner's rows and shifts another owner's scores by 1e-6."""
    copy = fx.scored.filter("owner <> 0").withColumn(
        "low_score", F.col("low_score") + F.when(F.col("owner") == 3, 1e-6).otherwise(0.0))
    return contracts.table_diff(fx.scored, copy, [*FOLD, "model_id"])


DENY = ("confidential", "password")


def _scan_sql() -> str:
    def lit(p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    parts = [f"SELECT '{n}' AS finding, count(*) FILTER (regexp_matches(text, {lit(p)})) AS texts FROM documents"
             for n, p in contracts.SENSITIVE_PATTERNS.items()]
    parts += [f"SELECT 'deny:{d}', count(*) FILTER (contains(lower(text), '{d}')) FROM documents" for d in DENY]
    return "\nUNION ALL ".join(parts)


@query("sensitive_scan", _scan_sql())
def sensitive_scan(fx):
    return contracts.sensitive_scan(fx.table("documents"), "text", deny=DENY)


