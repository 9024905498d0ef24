"""The registered queries of the engine's own operators, each with the SQL it is held against.

The operator ids in the comments are those of the blueprint. The test tables stand in for the annotation relations: turns of
``conversations`` are question and answer, ``documents`` are texts, ``lineitem`` gives boxes, ``orders`` and ``customer`` references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import geometry, nested, scalars, text
from ..operators import audit, images, items, merge, runs, stats, validate
from . import files, merging  # noqa: F401 register their queries
from . import sqltext as S
from .registry import ORACLE, QUERIES, query, read  # noqa: F401

FLAGSHIP = "item_shards"

TYPES = list(vocab.GROUPS)
_TYPES_SQL = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
#: Injected characters: the test tables hold none that cleaning changes.
ODD = "\u00a0\u200cক্\u200dয\u200d Café \u200b x3\ufeff । \""


def qa_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of the conversations: each user turn that an assistant turn follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = read(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("gold"))
    t = t.where("role = 'user' and next_role = 'assistant'").withColumn("slot", F.row_number().over(w))
    image = F.format_string("H%02d_%04d", F.pmod("conv_id", F.lit(50)), F.col("conv_id"))
    t = t.withColumn("image_id", image).withColumn("qa_type", F.element_at(F.array(*map(F.lit, TYPES)), (F.pmod(F.col("conv_id") + F.col("slot"), F.lit(8)) + 1).cast("int")))
    house = scalars.house_from_prefix(F.col("image_id"))
    return t.select(scalars.slot_id(F.col("image_id"), "q", F.col("slot")).alias("qa_id"), "image_id", house.alias("house_id"), F.concat("image_id", F.lit(".jpg")).alias("image_file"), "qa_type", scalars.group_of(F.col("qa_type")).alias("group"), F.col("text").alias("question"), "gold", F.col("slot").cast("int").alias("slot"), "conv_id")


ITEMS_SQL = f"""
t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS gold FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS slot, printf('H%02d_%04d', conv_id % 50, conv_id) AS image_id FROM t WHERE role = 'user' AND next_role = 'assistant'),
items AS (SELECT image_id || '_q' || slot AS qa_id, image_id, split_part(image_id, '_', 1) AS house_id, image_id || '.jpg' AS image_file, {_TYPES_SQL}[((conv_id + slot) % 8 + 1)::INT] AS qa_type,
  CASE WHEN {_TYPES_SQL}[((conv_id + slot) % 8 + 1)::INT] IN ('obj_function', 'assistive') THEN 'B' ELSE 'A' END AS "group", text AS question, gold, slot::INT AS slot, conv_id FROM s)"""
RANK_SQL = f"WITH {ITEMS_SQL}, ranked AS (SELECT row_number() OVER (ORDER BY md5('42|' || qa_id), qa_id) - 1 AS rank, * FROM items)"


# --- text: T1-T8, F8-F13, F16, F18 ---


@query(f"SELECT doc_id, {S.clean_for_scoring(f'concat(text, {chr(39)}{ODD}{chr(39)})')} AS cleaned FROM documents")
def text_clean_scoring(spark, d):
    """T2."""
    return read(spark, d, "documents").select("doc_id", text.clean_for_scoring(F.concat("text", F.lit(ODD))).alias("cleaned"))


@query(f"SELECT doc_id, {S.clean_for_storage(f'concat({chr(39)}{ODD}{chr(39)}, text)')} AS cleaned FROM documents")
def text_clean_storage(spark, d):
    """T1."""
    return read(spark, d, "documents").select("doc_id", text.clean_for_storage(F.concat(F.lit(ODD), "text")).alias("cleaned"))


_RAW = f"CASE WHEN doc_id % 2 = 0 THEN text ELSE concat(text, '{ODD}') END"
_VIS = r"regexp_replace(raw, '[\x{200b}\x{feff}\x{a0}]', '', 'g')"


@query(rf"""WITH r AS (SELECT {_RAW} AS raw FROM documents), a AS (SELECT *, {_VIS} AS v, {S.joiners(_VIS)} AS j FROM r WHERE raw <> '')
SELECT count(*) AS fields_seen, sum(contains(raw, chr(8203))::INT + contains(raw, chr(65279))::INT + contains(raw, chr(160))::INT)::BIGINT AS stripped_invisible, count_if(j <> v)::BIGINT AS fields_with_inert_joiner,
  sum(length(v) - length(j))::BIGINT AS inert_joiners_removed, sum(len(regexp_extract_all(v, '\x{{09cd}}[\x{{200c}}\x{{200d}}]')))::BIGINT AS functional_joiners_kept, count_if(nfc_normalize(j) <> j)::BIGINT AS nfc_changed,
  count_if({S.squeeze("nfc_normalize(j)")} <> nfc_normalize(j))::BIGINT AS whitespace_changed, count_if({S.squeeze("nfc_normalize(j)")} <> raw)::BIGINT AS fields_changed FROM a""")
def text_audit(spark, d):
    """AG13, Q2: what storage cleaning changes."""
    raw = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(ODD)))
    return text.storage_audit(read(spark, d, "documents").select(raw.alias("raw")), "raw")


_PRED = "CASE WHEN slot % 3 = 0 THEN gold || '।' WHEN slot % 3 = 1 THEN 'x ' || gold || ' y' ELSE question END"


@query(f"WITH {ITEMS_SQL}, m AS (SELECT qa_id, {S.clean_for_scoring(_PRED)} AS p, {S.clean_for_scoring('gold')} AS r FROM items) SELECT qa_id, r <> '' AND p = r AS strict, r <> '' AND contains(p, r) AS relaxed FROM m")
def match_strict_relaxed(spark, d):
    """T3, T4."""
    m = qa_items(spark, d).select("qa_id", text.clean_for_scoring(F.expr(_PRED)).alias("p"), text.clean_for_scoring(F.col("gold")).alias("r"))
    return m.select("qa_id", text.strict_match(F.col("p"), F.col("r")).alias("strict"), text.relaxed_match(F.col("p"), F.col("r")).alias("relaxed"))


_BN = "CASE WHEN doc_id % 2 = 0 THEN text ELSE translate(text, '0123456789', '০১২৩৪৫৬৭৮৯') || ' ৩' END"


@query(f"SELECT doc_id, CASE WHEN regexp_matches(t, '[0-9]') THEN 'ASCII' ELSE 'Bangla' END AS kind FROM (SELECT doc_id, {_BN} AS t FROM documents) WHERE regexp_matches(t, '[0-9০-৯]')")
def digit_forms(spark, d):
    """F9, F10."""
    rows = read(spark, d, "documents").select("doc_id", text.digit_kind(F.expr(_BN)).alias("kind"))
    return rows.where("kind is not null")


_END = "CASE WHEN slot % 2 = 0 THEN gold || '। ' ELSE gold END"


@query(f"WITH {ITEMS_SQL} SELECT qa_id, {S.strip(_END)} <> '' AND NOT ends_with({S.strip(_END)}, '।') AS no_daari FROM items")
def non_terminal_answers(spark, d):
    """F11."""
    return qa_items(spark, d).select("qa_id", text.lacks_daari(F.expr(_END)).alias("no_daari"))


_SLIP = "CASE WHEN slot % 2 = 0 THEN '  ' || question || ' ?।' ELSE gold END"


@query(f"WITH {ITEMS_SQL}, a AS (SELECT qa_id, question AS q, {_SLIP} AS a FROM items) SELECT qa_id, {S.strip('a')} <> '' AND {S.flat('a')} = {S.flat('q')} AS copied, {S.strip('a')} = '' OR {S.strip('q')} = '' AS blank FROM a")
def copy_slip(spark, d):
    """F12, F13, T6."""
    a = qa_items(spark, d).select("qa_id", F.col("question").alias("q"), F.expr(_SLIP).alias("a"))
    return a.select("qa_id", text.copied(F.col("a"), F.col("q")).alias("copied"), text.blank(F.col("q"), F.col("a")).alias("blank"))


@query("SELECT doc_id FROM documents WHERE nfc_normalize(t || text) <> t || text".replace("FROM documents", "FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'e' || chr(769) ELSE 'é' END AS t FROM documents)"))
def not_nfc(spark, d):
    """Composition is judged on both texts together."""
    t = F.when(F.col("doc_id") % 2 == 0, F.lit("e\u0301")).otherwise(F.lit("\u00e9"))
    return read(spark, d, "documents").where(text.not_nfc(t, F.col("text"))).select("doc_id")


@query(rf"SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 5 = 0 THEN 'ক' ELSE '' END, '[\x{{0980}}-\x{{09ff}}]') AS bangla, regexp_matches(text, '[A-Za-z]') AS latin, {S.words('text')} > 12 AS long, {S.words('text')}::INT AS words FROM documents")
def script_flags(spark, d):
    """F8, F9, F18, T5."""
    t = F.concat("text", F.when(F.col("doc_id") % 5 == 0, "ক").otherwise(""))
    n = text.word_count(F.col("text"))
    return read(spark, d, "documents").select("doc_id", text.has_bangla(t).alias("bangla"), text.has_latin(F.col("text")).alias("latin"), (n > vocab.LONG_ANSWER_WORDS).alias("long"), n.alias("words"))


# --- items: N12, W3, W4, P-columns, F7, AG12, AG17, AG18, AG23 ---


@query(f"WITH {ITEMS_SQL} SELECT qa_id, image_id, house_id, image_file, qa_type, \"group\", question, gold, slot FROM items")
def qa_flatten(spark, d):
    return qa_items(spark, d).drop("conv_id")


@query(f"{RANK_SQL} SELECT rank, qa_id FROM ranked")
def item_rank(spark, d):
    """W3, N3."""
    return items.rank_by_hash(qa_items(spark, d)).select("rank", "qa_id")


@query(f"{RANK_SQL} SELECT (rank % 4)::INT AS shard, count(*) AS n, avg({S.words('question')}) AS mean_words, min(rank) AS first_rank FROM ranked GROUP BY 1")
def item_shards(spark, d):
    """F7 over W3: the flagship."""
    ranked = items.rank_by_hash(qa_items(spark, d))
    return ranked.groupBy(F.pmod("rank", F.lit(4)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.avg(text.word_count(F.col("question"))).alias("mean_words"), F.min("rank").alias("first_rank"))


@query(f"{RANK_SQL} SELECT rank, qa_id FROM ranked WHERE rank % 3 = 1")
def shard_one(spark, d):
    """F7."""
    return items.shard(items.rank_by_hash(qa_items(spark, d)), 1, 3).select("rank", "qa_id")


@query(f"WITH {ITEMS_SQL}, c AS (SELECT count(*) AS n FROM items), g AS (SELECT n, unnest([2, 3, 4, 6, 8, 9])::INT AS shards FROM c), k AS (SELECT n, shards, unnest(range(shards))::INT AS k FROM g) SELECT shards, k, (n // shards + (k < n % shards)::INT)::BIGINT AS size FROM k")
def shard_sizes(spark, d):
    """AG23."""
    return items.shard_sizes(qa_items(spark, d).agg(F.count(F.lit(1)).alias("n")))


_RAWTYPE = "CASE o_orderpriority WHEN '1-URGENT' THEN ' Obj-Hazard ' WHEN '2-HIGH' THEN 'scene id' WHEN '3-MEDIUM' THEN 'assistive' WHEN '4-NOT SPECIFIED' THEN 'OBJ_FUNCTION' ELSE 'other' END"


@query(f"""WITH r AS (SELECT lower(replace(replace(trim({_RAWTYPE}), '-', '_'), ' ', '_')) AS t FROM orders), c AS (SELECT CASE WHEN t = 'obj_hazard' THEN 'obj_property' WHEN t = 'other' THEN NULL ELSE t END AS qa_type FROM r)
SELECT qa_type, CASE WHEN qa_type IN ('obj_function', 'assistive') THEN 'B' WHEN qa_type IS NOT NULL THEN 'A' END AS "group", CASE WHEN qa_type IN ('obj_function', 'assistive') THEN 96 ELSE 32 END AS max_tokens, count(*) AS n FROM c GROUP BY ALL""")
def canon_group(spark, d):
    """P6, P7, P16."""
    c = read(spark, d, "orders").select(scalars.canon_type(F.expr(_RAWTYPE)).alias("qa_type")).withColumn("group", scalars.group_of(F.col("qa_type")))
    return c.withColumn("max_tokens", scalars.token_budget(F.col("group"), F.col("qa_type"))).groupBy("qa_type", "group", "max_tokens").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT c_custkey, upper(nullif(regexp_extract('up/h' || c_custkey || '_' || c_nationkey || '.jpg', '(?i)(H[0-9]+_[0-9]+)', 1), '')) AS image_id, 'H' || c_custkey AS house_id, printf('H%02d', c_custkey) AS folder_house,
regexp_replace(regexp_extract('a\b/' || c_name || '.x.JPG', '[^/\\]*$', 0), '\.[^.]*$', '') || '.jpg' AS image_file, CASE WHEN length(c_name || repeat('y', 50)) > 60 THEN left(c_name || repeat('y', 50), 60) || ' ...' ELSE c_name || repeat('y', 50) END AS shown,
regexp_replace(lower('models/' || c_mktsegment || ' v#1')[8:], '[^\p{L}\p{N}\-_.]', '-', 'g') AS tag, trunc(c_acctbal)::INT AS balance FROM customer""")
def identifiers(spark, d):
    """P1-P3, P8, P9, P12, P17, P22."""
    up = F.concat(F.lit("up/h"), "c_custkey", F.lit("_"), "c_nationkey", F.lit(".jpg"))
    image = scalars.image_id(F.lit(None).cast("string"), up)
    return read(spark, d, "customer").select(
        "c_custkey", image.alias("image_id"), scalars.house_id(image).alias("house_id"), scalars.house_from_folder(F.concat(F.lit("House "), "c_custkey")).alias("folder_house"),
        scalars.flat_image_file(F.concat(F.lit("a\\b/"), "c_name", F.lit(".x.JPG"))).alias("image_file"), scalars.truncate(F.concat("c_name", F.repeat(F.lit("y"), F.lit(50)))).alias("shown"),
        scalars.model_tag(F.concat(F.lit("models/"), "c_mktsegment", F.lit(" v#1"))).alias("tag"), scalars.as_int(F.col("c_acctbal")).alias("balance"),
    )


# --- resume and references: J1-J12, AG12, AG18, AG26 ---


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_todo(spark, d):
    """J9, S8, U4."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("qa_id"), "lang")
    return items.todo(docs, read(spark, d, "labels").select(F.col("doc_id").alias("qa_id"))).select(F.col("qa_id").alias("doc_id"), "lang")


_REFERS, _THERE = "CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE -o_custkey END", "CASE WHEN c_nationkey < 20 THEN c_custkey ELSE c_custkey + 100000000 END"


@query(f"""WITH a AS (SELECT DISTINCT {_REFERS} AS id FROM orders), b AS (SELECT {_THERE} AS id FROM customer)
SELECT id, 'missing' AS side FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'unreferenced' AS side FROM b WHERE id NOT IN (SELECT id FROM a)""")
def referential_both_ways(spark, d):
    """J7, U3."""
    return audit.references(read(spark, d, "orders").select(F.expr(_REFERS).alias("id")), read(spark, d, "customer").select(F.expr(_THERE).alias("id")), "id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    """AG12."""
    return audit.duplicate_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_IMAGE = "CAST(CASE WHEN o_orderstatus = 'P' THEN o_custkey + 100000000 ELSE o_custkey END AS STRING)"


@query(f"""WITH m AS (SELECT c_custkey::VARCHAR AS id, c_nationkey % 5 = 0 AS skip FROM customer), o AS (SELECT DISTINCT {_IMAGE} AS id, o_custkey % 10 AS r FROM orders), k AS (SELECT id FROM m WHERE skip), acc AS (SELECT id FROM o UNION SELECT id FROM k)
SELECT (SELECT count(*) FROM m) AS manifest_total, (SELECT count(*) FROM o WHERE r < 6) AS in_dataset, (SELECT count(*) FROM o WHERE r IN (6, 7)) AS excluded, (SELECT count(*) FROM o WHERE r > 7) AS dropped_degenerate, (SELECT count(*) FROM k) AS intentional_skips,
(SELECT count(*) FROM m WHERE id NOT IN (SELECT id FROM acc)) AS real_gap_count, (SELECT count(*) FROM o WHERE id NOT IN (SELECT id FROM m)) AS extra_count""")
def completeness(spark, d):
    """AG26, J6, J11, U2, U3: orders are records of the three routes, customers the manifest and its skips."""
    c = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("image_id"), F.when(F.col("c_nationkey") % 5 == 0, "skipped_or_empty").alias("issue"))
    o = read(spark, d, "orders").select(F.expr(_IMAGE).alias("image_id"), (F.col("o_custkey") % 10).alias("r"))
    m = merge.Merged(o.where("r < 6"), o.where("r in (6, 7)"), o.where("r > 7"), None, c, None, None)
    return merge.completeness(m, c).select("manifest_total", "in_dataset", "excluded", "dropped_degenerate", "intentional_skips", "real_gap_count", F.col("extra_not_in_manifest_count").alias("extra_count"))


@query(f"""WITH {ITEMS_SQL}, o AS (SELECT qa_type, count(*) AS observed FROM items GROUP BY 1), e AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::BIGINT)" for k, v in vocab.EXPECTED_COUNTS.items() if k != 'count')}) v(qa_type, expected))
SELECT qa_type, coalesce(observed, 0) AS observed, expected, CASE WHEN expected IS NULL THEN 'UNKNOWN' WHEN observed = expected THEN 'PASS' ELSE 'MISMATCH' END AS verdict FROM o FULL JOIN e USING (qa_type)""")
def expected_counts(spark, d):
    """J10, AG18."""
    return validate.expected_counts(qa_items(spark, d), "qa_type", {k: v for k, v in vocab.EXPECTED_COUNTS.items() if k != "count"})


@query(f"WITH {ITEMS_SQL} SELECT count(*) AS lines, count(DISTINCT qa_id) AS ids, count(DISTINCT image_id) AS images, count_if(\"group\" = 'A')::BIGINT AS group_a, count_if(\"group\" = 'B')::BIGINT AS group_b, count(*) = 18276 AND count(DISTINCT qa_id) = count(*) AND count(DISTINCT image_id) = 4406 AS ok FROM items")
def expected_totals(spark, d):
    """AG18."""
    return validate.totals(qa_items(spark, d))


@query("""SELECT o_orderkey, coalesce(c_name, '') AS annotator, coalesce(CASE WHEN o_orderstatus = 'O' THEN 'own' END, CASE WHEN n_regionkey < 3 THEN n_name END, '') AS split
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def dimension_lookups(spark, d):
    """Look-ups with defaults."""
    c = read(spark, d, "customer").where("c_acctbal > 0")
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("house_id"), F.when(F.col("n_regionkey") < 3, F.col("n_name")).alias("split"))
    o = read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("annotator"), F.col("c_nationkey").alias("house_id"), F.when(F.col("o_orderstatus") == "O", "own").alias("split"))
    return stats.with_split(o, nation).select("o_orderkey", "annotator", F.col("_split").alias("split"))


_FILE = "CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_brand = 'Brand#11' THEN 'other' WHEN p_brand = 'Brand#12' AND p_size % 5 > 1 THEN p_brand || '_x.jpg' WHEN p_size % 5 = 1 THEN p_brand || '.png' ELSE p_brand || '.jpg' END"


@query(f"""WITH i AS (SELECT DISTINCT p_brand AS image_id, p_brand || '.jpg' AS image_file FROM part), f AS (SELECT DISTINCT {_FILE} AS name FROM part)
SELECT image_id, image_file, CASE WHEN count(name) = 0 THEN 'missing' WHEN NOT bool_or(name = image_file) THEN 'wrong_extension' ELSE 'ok' END AS status FROM i LEFT JOIN f ON regexp_replace(name, '[.][^.]*$', '') = image_id GROUP BY ALL""")
def image_references(spark, d):
    """J8, F17."""
    p = read(spark, d, "part")
    return audit.image_check(p.select(F.col("p_brand").alias("image_id"), F.concat("p_brand", F.lit(".jpg")).alias("image_file")), p.select(F.expr(_FILE).alias("name")).distinct())


@query("""SELECT count(*) AS paths, count_if(contains(f, '/') OR contains(f, '\\'))::BIGINT AS with_folder, count_if(regexp_replace(regexp_extract(replace(f, '\\', '/'), '[^/]*$', 0), '[.][^.]*$', '') <> p_name)::BIGINT AS stem_differs
FROM (SELECT p_name, CASE WHEN p_size % 3 = 0 THEN p_brand || '/' || p_name || '.jpg' WHEN p_size % 3 = 1 THEN 'x\\' || p_brand || '.jpg' ELSE p_name || '.jpg' END AS f FROM part)""".replace("\\\\", "\\"))
def packaging(spark, d):
    """F14, F15."""
    size = F.col("p_size") % 3
    f = F.when(size == 0, F.concat("p_brand", F.lit("/"), "p_name", F.lit(".jpg"))).when(size == 1, F.concat(F.lit("x\\"), "p_brand", F.lit(".jpg"))).otherwise(F.concat("p_name", F.lit(".jpg")))
    return audit.packaging_counts(read(spark, d, "part").select(F.col("p_name").alias("image_id"), f.alias("image_file")))


# --- statistics: AG1-AG11, AG15, AG17, AG24, AG25 ---


@query(f"SELECT lang, min(n) AS min, median(n)::DOUBLE AS median, {S.half_up('avg(n)', 2)} AS mean, max(n) AS max, count(n) AS n FROM (SELECT lang, {S.words('text')}::INT AS n FROM documents) GROUP BY 1")
def describe_lengths(spark, d):
    """AG1, AG5."""
    n = read(spark, d, "documents").select("lang", text.word_count(F.col("text")).alias("n"))
    return n.groupBy("lang").agg(stats.describe(F.col("n")).alias("s")).select("lang", "s.*")


@query("SELECT lang, quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def crosstab(spark, d):
    """AG3."""
    return stats.crosstab(read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left"), "lang", "quality")


_ORDERS_SPLIT = "CASE WHEN o_custkey % 10 < 7 THEN 'train' WHEN o_custkey % 10 = 7 THEN 'val' WHEN o_custkey % 10 = 8 THEN 'test' ELSE '' END"


_ANNOTATOR = "CASE WHEN o_custkey % 11 > 0 THEN concat('A', o_custkey % 4) ELSE '' END"
_WIDE = "CASE WHEN o_orderkey % 3 = 0 THEN 800 ELSE 600 END"


@query(f"""WITH g AS (SELECT {_ORDERS_SPLIT} AS split, o_orderpriority AS room_type, o_orderstatus AS capture_type, {_ANNOTATOR} AS annotator_id, concat('H', o_custkey % 97) AS house_id, {_WIDE} || 'x' || CASE WHEN o_orderkey % 5 = 0 THEN 800 ELSE 600 END AS image_size,
CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 'landscape' WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0 THEN 'portrait' ELSE 'square' END AS orientation FROM orders)
SELECT metric, key, count(*) AS n FROM (UNPIVOT (SELECT * FROM g) ON COLUMNS(*) INTO NAME metric VALUE key) GROUP BY ALL""")
def group_counts(spark, d):
    """AG2, AG4, AG25: seven groupings in one pass."""
    o = read(spark, d, "orders").select(F.expr(_ORDERS_SPLIT).alias("_split"), F.col("o_orderpriority").alias("room_type"), F.col("o_orderstatus").alias("capture_type"), F.expr(_ANNOTATOR).alias("annotator_id"), F.concat(F.lit("H"), F.col("o_custkey") % 97).alias("house_id"), F.expr(_WIDE).alias("image_w"), F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 800 ELSE 600 END").alias("image_h"))
    return stats.group_counts(o)


@query("SELECT CASE WHEN p_size * 40 < p_retailprice THEN 'portrait' WHEN p_size * 40 > p_retailprice THEN 'landscape' ELSE 'square' END AS o3, CASE WHEN p_retailprice >= p_size * 40 THEN 'portrait' ELSE 'landscape' END AS o2, p_size || 'x' || 'None' AS size, count(*) AS n FROM part GROUP BY ALL")
def orientations(spark, d):
    """P11, P15."""
    w, h = F.col("p_size") * 40, F.col("p_retailprice")
    return read(spark, d, "part").groupBy(scalars.orientation3(w, h).alias("o3"), scalars.orientation(w, h).alias("o2"), scalars.size_label(F.col("p_size"), F.lit(None)).alias("size")).agg(F.count(F.lit(1)).alias("n"))


def _release(spark, d):
    """Orders as records: line items are the boxes, statuses the capture types."""
    box = F.struct(F.concat("l_orderkey", F.lit("_b"), "l_linenumber").alias("object_id"), F.col("l_returnflag").alias("bangla_name"), F.array(F.col("l_linenumber"), F.lit(0), F.col("l_quantity").cast("int"), F.lit(40)).alias("bbox"), F.array(F.lit(0.0)).alias("bbox_pct"))
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(box).alias("objects"))
    qa = F.array(F.struct(F.concat("o_orderkey", F.lit("_q1")).alias("qa_id"), F.lit("count").alias("type"), F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("answer")))
    o = read(spark, d, "orders").join(lines, "o_orderkey", "left")
    return o.select(F.col("o_orderkey").cast("string").alias("image_id"), F.concat(F.lit("H"), F.col("o_custkey") % 97).alias("house_id"), F.when(F.col("o_custkey") % 11 > 0, F.concat(F.lit("A"), F.col("o_custkey") % 4)).otherwise("").alias("annotator_id"), F.lit("x.jpg").alias("image_file"), F.lit(40).alias("image_w"), F.lit(30).alias("image_h"), F.when(F.col("o_orderstatus") == "F", "overview").when(F.col("o_orderstatus") == "O", "closeup").otherwise("P").alias("capture_type"), F.when(F.col("o_orderpriority").startswith("1"), "NA").otherwise(F.lower("o_orderpriority")).alias("room_type"), F.coalesce("objects", F.array().cast(f"array<{vocab.BOX}>")).alias("objects"), qa.alias("qa_pairs"), F.expr(_ORDERS_SPLIT).alias("split"))


_REL = f"""WITH l AS (SELECT l_orderkey AS k, count(*) AS boxes FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, 'H' || (o_custkey % 97) AS house, CASE WHEN o_custkey % 11 > 0 THEN 'A' || (o_custkey % 4) ELSE '' END AS annot, coalesce(boxes, 0) AS boxes, {_ORDERS_SPLIT} AS split,
CASE o_orderstatus WHEN 'F' THEN 'overview' WHEN 'O' THEN 'closeup' ELSE 'P' END AS cap FROM orders LEFT JOIN l ON k = o_orderkey)"""


@query(f"{_REL} SELECT split, count(*) AS images, count(DISTINCT house) AS houses, count(*) AS qa_pairs, sum(boxes)::BIGINT AS boxes, count_if(cap = 'overview')::BIGINT AS overview, count_if(annot = 'A1')::BIGINT AS a1 FROM r WHERE split <> '' GROUP BY 1")
def per_split(spark, d):
    """AG10; maps are read at a key each."""
    at = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0))
    r = _release(spark, d).withColumnRenamed("split", "_split")
    return stats.per_split(r).select("split", "images", "houses", F.col("qa_pairs").cast("long").alias("qa_pairs"), F.col("boxes").cast("long").alias("boxes"), at("capture_type", "overview").alias("overview"), at("annotator_id", "A1").alias("a1"))


@query(f"{_REL} SELECT count(*) AS total, count_if(cap = 'overview')::BIGINT AS scene, count_if(cap = 'closeup')::BIGINT AS closeup, count(*) AS qa_pairs, sum(boxes)::BIGINT AS boxes FROM r")
def release_counts(spark, d):
    """AG24, AG7."""
    return merge.release_counts(_release(spark, d))


_PROBLEMS = """u AS (SELECT o_orderkey::VARCHAR AS id, unnest(list_concat(
  CASE WHEN cap = 'P' THEN ['bad_capture_type'] ELSE [] END, CASE WHEN o_orderpriority[1:1] <> '1' THEN ['bad_room_type'] ELSE [] END, CASE WHEN annot = '' THEN ['missing_annotator_id'] ELSE [] END, ['qa_count'],
  ['latin_chars'], CASE WHEN regexp_matches(o_orderpriority, '[0-9]') THEN ['ascii_digits'] ELSE [] END, CASE WHEN cap = 'overview' AND boxes <> 1 THEN ['scene_boxes'] ELSE [] END)) AS kind FROM r
  UNION ALL SELECT l_orderkey::VARCHAR, 'latin_chars_in_bbox_name' FROM lineitem UNION ALL
  SELECT l_orderkey::VARCHAR, 'bbox_out_of_bounds' FROM lineitem WHERE l_quantity::INT > 0)"""


@query(f"{_REL}, {_PROBLEMS} SELECT kind, count(*) AS n FROM u GROUP BY 1")
def problem_kinds(spark, d):
    """V1, AG15."""
    return validate.kinds(validate.problems(_release(spark, d)))


@query(f"{_REL}, {_PROBLEMS} SELECT id AS image_id, string_agg(kind, ',' ORDER BY kind) AS problems FROM u GROUP BY 1")
def validate_rules(spark, d):
    """V1."""
    return validate.problems(_release(spark, d)).select("image_id", F.array_join(F.array_sort(F.transform("problems", scalars.problem_kind)), ",").alias("problems"))


@query(f"""{_REL}, x AS (SELECT o_orderkey AS k FROM r UNION ALL SELECT o_orderkey FROM r WHERE o_orderkey % 10 = 0), o AS (SELECT CASE WHEN l_linenumber = 3 THEN '' ELSE l_orderkey || '_b' || l_linenumber END AS id FROM x JOIN lineitem ON l_orderkey = k)
SELECT (SELECT count(*) - count(DISTINCT k) FROM x) AS duplicate_image_ids, (SELECT count_if(k % 7 = 0)::BIGINT FROM x) AS records_missing_image_dims, (SELECT count(*) - count(DISTINCT CASE WHEN k % 5 = 0 THEN '' ELSE k || '_q1' END) FROM x) AS duplicate_qa_ids,
(SELECT count_if(k % 5 = 0)::BIGINT FROM x) AS blank_qa_ids, (SELECT count_if(k % 3 = 0)::BIGINT FROM x) AS qa_fields_not_nfc, (SELECT count(*) - count(DISTINCT id) FROM o) AS duplicate_object_ids, (SELECT count_if(id = '')::BIGINT FROM o) AS blank_object_ids""")
def integrity(spark, d):
    """AG11, over records some of which come twice, lack sizes or ids, or hold text that is not composed."""
    r, k = _release(spark, d), F.col("image_id").cast("long")
    qa = F.transform("qa_pairs", lambda q: F.struct(F.when(k % 5 == 0, "").otherwise(q["qa_id"]).alias("qa_id"), q["type"].alias("type"), F.when(k % 3 == 0, F.concat(F.lit("e\u0301"), q["question"])).otherwise(q["question"]).alias("question"), q["answer"].alias("answer")))
    boxes = F.transform("objects", lambda o: o.withField("object_id", F.when(F.endswith(o["object_id"], F.lit("_b3")), "").otherwise(o["object_id"])))
    return stats.integrity(r.union(r.where(k % 10 == 0)).withColumns({"qa_pairs": qa, "objects": boxes, "image_w": F.when(k % 7 == 0, 0).otherwise(F.col("image_w"))}))


_WORDS = "SELECT unnest(string_split(text, ' ')) AS name FROM documents"


@query(f"SELECT name, count(*) AS n FROM ({_WORDS}) WHERE name <> '' GROUP BY 1 ORDER BY n DESC, name LIMIT 30")
def lexicon_topk(spark, d):
    """AG8, AG9."""
    w = read(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("name")).where("name <> ''")
    return stats.top(stats.frequencies(w, "name"), 30)


@query(f"WITH f AS (SELECT name, count(*) AS n FROM ({_WORDS}) WHERE name <> '' GROUP BY 1) SELECT count(*) AS size, count_if(n >= 20)::BIGINT AS ge20, count_if(n >= 10)::BIGINT AS ge10, count_if(n >= 5)::BIGINT AS ge5, count_if(n = 1)::BIGINT AS singletons, sum(n)::BIGINT AS named FROM f")
def lexicon_thresholds(spark, d):
    """AG8."""
    w = read(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("name")).where("name <> ''")
    return stats.lexicon(stats.frequencies(w, "name"))


@query("SELECT name, n FROM (SELECT event_type AS name, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1) ORDER BY n DESC, f LIMIT 3")
def top_first_seen(spark, d):
    """AG9: ties in the order of first occurrence."""
    return stats.top(stats.frequencies(read(spark, d, "events").select(F.col("event_type").alias("name"), "event_id"), "name", ["event_id"]), 3)


@query(f"SELECT count(*) AS total, count(DISTINCT text) AS \"unique\", {S.half_up('1 - count(DISTINCT text) / greatest(count(*), 1)', 4)} AS reuse_rate FROM documents")
def reuse_rate(spark, d):
    """AG6."""
    return stats.reuse(read(spark, d, "documents"), "text")


@query("SELECT n, count(*) AS records FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) GROUP BY 1")
def histogram(spark, d):
    """AG17."""
    return stats.histogram(read(spark, d, "conversations"), "conv_id")


# --- geometry: G1, G2, F4, AG14, AG22, P14, P18-P20, W1, W2, W6 ---

_BOX = "l_quantity * 3.0 - 20.0 AS x, l_linenumber * 9.0 - 12.0 AS y, l_discount * 700.0 + 5.0 AS w, l_tax * 900.0 + 6.0 AS h, 640 AS ow, 480 AS oh"
_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
_GEO = f"WITH b AS (SELECT {_KEY}, {_BOX} FROM lineitem), {S.GEOMETRY}"


def _boxes(spark, d):
    b = read(spark, d, "lineitem").selectExpr(*_KEY.split(", "), *_BOX.split(", "))
    return b, geometry.box(*[F.col(c) for c in ("x", "y", "w", "h", "ow", "oh")])


@query(f"{_GEO} SELECT l_orderkey, l_linenumber, px, py, pw, ph, over_px, lost FROM g")
def box_clip(spark, d):
    """G1."""
    b, g = _boxes(spark, d)
    b = b.select("l_orderkey", "l_linenumber", g["px"].alias("p"), g["over_px"].alias("over_px"), g["lost"].alias("lost"))
    return b.select("l_orderkey", "l_linenumber", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("px", "py", "pw", "ph"))], "over_px", "lost")


@query(f"{_GEO} SELECT count_if(out)::BIGINT AS out_of_frame, count_if(out)::BIGINT AS clipped, count_if(out AND (nw <= 0 OR nh <= 0))::BIGINT AS empty_after_clip, count_if(100.0 - lost < 15.0 OR pw < 16 OR ph < 16)::BIGINT AS degenerate FROM g")
def box_degenerate(spark, d):
    """G2, F4."""
    b, g = _boxes(spark, d)
    return b.agg(*[F.count_if(g[c]).alias(c) for c in ("out_of_frame", "clipped", "empty_after_clip")], F.count_if(geometry.degenerate(g["px"], g["lost"])).alias("degenerate"))


@query(f"{_GEO}, s AS (SELECT list_sort(list(over_px)) AS o, list_sort(list(lost)) AS l FROM g WHERE over_px > 0) SELECT o[1] AS overflow_px_min, o[len(o) // 2 + 1] AS overflow_px_median, o[len(o)] AS overflow_px_max, l[1] AS area_lost_pct_min, l[len(l) // 2 + 1] AS area_lost_pct_median, l[len(l)] AS area_lost_pct_max FROM s")
def overflow_upper_median(spark, d):
    """AG14."""
    b, g = _boxes(spark, d)
    one = F.struct(*[g[c].alias(c) for c in ("over_px", "lost", "out_of_frame", "clipped", "empty_after_clip")], F.lit(False).alias("degenerate"))
    every = b.select(F.lit("").alias("image_id"), F.array(one).alias("_boxes"))
    return merge.clip_audit(every).select(*[f"{a}_{k}" for a in ("overflow_px", "area_lost_pct") for k in ("min", "median", "max")])


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY round_even(l_quantity, 4), round_even(l_extendedprice, 4), l_partkey, l_suppkey, l_linenumber, l_shipdate, l_discount, l_tax)::INT AS object_no FROM lineitem")
def box_number(spark, d):
    """Numbers inside a record, by place."""
    lines = read(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_discount", "l_tax").alias("region"))
    out = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("x", "y", "region")).alias("b")).select("l_orderkey", F.posexplode(merge.in_place("b", lambda b: (b["x"], b["y"], b["region"]))).alias("i", "b"))
    return out.select("l_orderkey", "b.region.l_partkey", "b.region.l_suppkey", "b.region.l_linenumber", (F.col("i") + 1).alias("object_no"))


@query("""WITH s AS (SELECT p_partkey, p_size * 37 + 500 AS w, (p_partkey % 1900 + 300)::INT AS h FROM part) SELECT p_partkey,
CASE WHEN least(w, h) <= 768 THEN w WHEN w <= h THEN 768 ELSE greatest(1, round_even(w * 768.0::DOUBLE / h, 0)::INT) END AS short_w, CASE WHEN least(w, h) <= 768 THEN h WHEN w <= h THEN greatest(1, round_even(h * 768.0::DOUBLE / w, 0)::INT) ELSE 768 END AS short_h,
CASE WHEN greatest(w, h) <= 2048 THEN w WHEN w >= h THEN 2048 ELSE greatest(1, round_even(w * 2048.0::DOUBLE / h, 0)::INT) END AS long_w, CASE WHEN greatest(w, h) <= 2048 THEN h WHEN w >= h THEN greatest(1, round_even(h * 2048.0::DOUBLE / w, 0)::INT) ELSE 2048 END AS long_h,
CASE WHEN least(w, h) > 768 THEN round_even(w * (768.0::DOUBLE / least(w, h)), 0)::INT ELSE w END AS guard_w, CASE WHEN least(w, h) > 768 THEN round_even(h * (768.0::DOUBLE / least(w, h)), 0)::INT ELSE h END AS guard_h FROM s""")
def resize_plan(spark, d):
    """P18-P20."""
    s = read(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 500).alias("w"), (F.col("p_partkey") % 1900 + 300).cast("int").alias("h"))
    plans = {"short": geometry.short_side_plan, "long": geometry.long_edge_plan, "guard": geometry.guard_plan}
    return s.select("p_partkey", *[f(F.col("w"), F.col("h"))[k].cast("int").alias(f"{n}_{k}") for n, f in plans.items() for k in "wh"])


@query(f"SELECT count_if(least(p_size * 32, 800) = 768)::BIGINT AS exact, count_if(least(p_size * 32, 800) < 768)::BIGINT AS smaller, count_if(least(p_size * 32, 800) > 768)::BIGINT AS oversized FROM part")
def short_sides(spark, d):
    """AG22."""
    return images.short_sides(read(spark, d, "part").select((F.col("p_size") * 32).alias("w"), F.lit(800).alias("h")))


@query(f"SELECT p_partkey, {S.half_up('p_size * 11 / (p_retailprice * 640)', 4)} AS fraction FROM part")
def area_fraction(spark, d):
    """P14."""
    return read(spark, d, "part").select("p_partkey", geometry.area_fraction(F.col("p_size"), F.lit(11), F.col("p_retailprice"), F.lit(640)).alias("fraction"))


@query("SELECT printf('H%02d_%04d', c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_name), c_name)) AS image_id, c_name AS name FROM customer WHERE c_acctbal > 100")
def image_numbers(spark, d):
    """Numbers are given to images that decode only."""
    c = read(spark, d, "customer").select(F.concat(F.lit("house-"), "c_nationkey").alias("folder"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 100).alias("ok"))
    return images.number(c).select("image_id", "name")


@query("WITH f AS (SELECT p_brand || CASE WHEN p_size < 25 THEN '.png' ELSE '.jpg' END || p_size AS name, p_brand AS stem FROM part), g AS (SELECT DISTINCT stem || '.' || regexp_extract(name, '[^.]*$') AS name, stem FROM f) SELECT first(name) OVER (PARTITION BY stem ORDER BY name) AS first, name AS later FROM g QUALIFY row_number() OVER (PARTITION BY stem ORDER BY name) > 1")
def duplicate_stems(spark, d):
    """W6."""
    p = read(spark, d, "part")
    return images.duplicate_stems(p.select(F.concat("p_brand", F.when(F.col("p_size") < 25, ".png").otherwise(".jpg"), "p_size").alias("name")).distinct())


# --- nested data and dedupe: D1, D2, N10, N11, N13, N15, N16, S2, S12 ---


@query("SELECT user_id, event_type, last(event_id ORDER BY ts, event_id) AS event_id, last(value ORDER BY ts, event_id) AS value FROM events GROUP BY ALL")
def last_wins(spark, d):
    """D1, D2."""
    return merge.last_wins(read(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_field(spark, d):
    """A field of a JSON map."""
    return read(spark, d, "events").select("event_id", scalars.as_int(nested.present(F.from_json("props", "map<string,string>"), ["q", "k"])).alias("k"))


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS at, l_partkey, l_quantity FROM lineitem")
def regroup_nested(spark, d):
    """Rows are regrouped into ordered arrays and taken apart again."""
    o = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*o))).alias("x"))
    return g.select("l_orderkey", F.posexplode("x").alias("i", "x")).select("l_orderkey", (F.col("i") + 1).cast("long").alias("at"), "x.l_partkey", "x.l_quantity")


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ ]')), ' ') AS joined FROM documents")
def join_parts(spark, d):
    """N15."""
    return read(spark, d, "documents").select("doc_id", text.join_parts(F.split("text", "\n")).alias("joined"))


_LAYOUT = "CASE WHEN conv_id % 4 = 3 AND c = 1 THEN 'single' WHEN conv_id % 4 = 1 AND c <= 8 THEN 'dict' WHEN conv_id % 4 = 2 THEN 'flat' ELSE 'list' END"


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS c FROM items), y AS (SELECT *, {_LAYOUT} AS layout FROM c),
once AS (SELECT * FROM y QUALIFY layout <> 'flat' OR row_number() OVER (PARTITION BY conv_id, qa_type ORDER BY slot DESC) = 1),
known AS (SELECT *, CASE WHEN layout = 'flat' THEN row_number() OVER (PARTITION BY conv_id ORDER BY list_position({_TYPES_SQL}, qa_type)) WHEN layout = 'single' THEN slot ELSE slot + 1 END AS no FROM once)
SELECT image_id || '_q' || no AS qa_id, qa_type, question, gold, layout FROM known""")
def layouts(spark, d):
    """All pairs of a conversation in one record of one of four layouts, with an entry of an unknown type before them. Entries of lists
    and maps count for the slot even if their type is unknown; flat fields are numbered in the order of the types."""
    pair = F.struct("slot", "qa_type", "question", "gold")
    i = qa_items(spark, d).groupBy("conv_id", "image_id").agg(F.array_sort(F.collect_list(pair)).alias("p")).withColumn("c", F.size("p")).withColumn("layout", F.expr(_LAYOUT))
    one = F.get("p", F.lit(0))
    strange = F.struct(F.lit("strange").alias("type"), F.lit("q").alias("question"), F.lit("a").alias("answer"))
    as_list = F.concat(F.array(strange), F.transform("p", lambda x: F.struct(x["qa_type"].alias("type"), x["question"].alias("question"), x["gold"].alias("answer"))))
    entry = lambda x: F.concat(F.lit('"'), x["qa_type"], F.lit('":'), F.to_json(F.struct(x["question"].alias("q"), x["gold"].alias("a"))))
    as_dict = F.concat(F.lit('{"strange":{"q":"x"},'), F.array_join(F.transform("p", entry), ","), F.lit("}"))
    last = F.filter("p", lambda x: ~F.exists("p", lambda y: (y["qa_type"] == x["qa_type"]) & (y["slot"] > x["slot"])))
    flat = F.map_from_entries(F.flatten(F.transform(last, lambda x: F.array(F.struct(F.concat(F.lit("q_"), x["qa_type"]).alias("k"), x["question"].alias("v")), F.struct(F.concat(F.lit("a_"), x["qa_type"]).alias("k"), x["gold"].alias("v"))))))
    record = (
        F.when(F.col("layout") == "list", F.to_json(F.struct("image_id", as_list.alias("qa_pairs"))))
        .when(F.col("layout") == "dict", F.concat(F.expr("left(to_json(struct(image_id)), length(to_json(struct(image_id))) - 1)"), F.lit(',"qa":'), as_dict, F.lit("}")))
        .when(F.col("layout") == "flat", F.to_json(flat))
        .otherwise(F.to_json(F.struct("image_id", one["qa_type"].alias("qa_type"), one["question"].alias("question"), one["gold"].alias("gold"))))
    )
    out = nested.question_answers(i.select("image_id", record.alias("record")))
    return out.select("layout", F.explode("qas").alias("q")).select("q.qa_id", "q.qa_type", F.col("q.question").alias("question"), F.col("q.gold").alias("gold"), "layout")


# --- runs and scores: AG19-AG21, J12, W5, W7, P21 ---


@query("""WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_s, round(avg(CASE WHEN c <= 4 OR i > 3 THEN value END), 6) AS warm_mean_s FROM n GROUP BY 1""")
def latency_summary(spark, d):
    """AG19, W5."""
    out = runs.latency(read(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value")
    return out.select("event_type", "n", F.round("mean_s", 6).alias("mean_s"), F.round("warm_mean_s", 6).alias("warm_mean_s"))


@query("""SELECT n_nationkey, workers, (18276.0::DOUBLE / workers) * (n_nationkey + 0.5) / 3600.0 AS hours, (18276.0::DOUBLE / workers) * (n_nationkey + 0.5) / 3600.0 <= 12 AS fits FROM nation, (SELECT unnest([1, 2, 3, 4, 6, 8])::INT AS workers)""")
def hours_projection(spark, d):
    """AG20."""
    speed = read(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") + F.lit(0.5)).alias("warm_mean_s"))
    return runs.projection(speed, vocab.EXPECTED_QA).select("n_nationkey", "workers", "hours", "fits")


@query(rf"""WITH a AS (SELECT lang, CASE WHEN doc_id % 7 = 1 THEN 'ক ' || text ELSE text END AS t FROM documents) SELECT lang, count(*) AS n, count_if({S.strip('t')} = '')::BIGINT AS empty,
count_if({S.strip('t')} <> '' AND NOT regexp_matches(t, '[\x{{0980}}-\x{{09ff}}]'))::BIGINT AS no_bangla, count_if({S.strip('t')} <> '' AND {S.words('t')} > 12)::BIGINT AS long FROM a GROUP BY 1""")
def answer_quality(spark, d):
    """AG21."""
    t = F.when(F.col("doc_id") % 7 == 1, F.concat(F.lit("ক "), "text")).otherwise(F.col("text"))
    return runs.quality(read(spark, d, "documents").select("lang", t.alias("raw_output")), ["lang"])


@query(f"WITH {ITEMS_SQL}, m AS (SELECT qa_type, {S.clean_for_scoring(_PRED)} AS p, {S.clean_for_scoring('gold')} AS r FROM items) SELECT qa_type, count(*) AS n, count_if(r <> '' AND p = r)::BIGINT AS strict, count_if(r <> '' AND contains(p, r))::BIGINT AS relaxed FROM m GROUP BY 1")
def score_by_type(spark, d):
    """J12, T2-T4."""
    i = qa_items(spark, d)
    return runs.score(i.select("qa_id", "qa_type", "gold"), i.select("qa_id", F.expr(_PRED).alias("raw_output")), ["qa_type"])


@query("""WITH e AS (SELECT event_type AS model_id, event_id, value > 50 AS failed, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - row_number() OVER (PARTITION BY event_type, value > 50 ORDER BY event_id) AS g FROM events)
SELECT model_id, min(event_id) AS start, max(event_id) AS "end", count(*) AS n FROM e WHERE failed GROUP BY model_id, g""")
def error_runs(spark, d):
    """Runs of consecutive failures."""
    return runs.error_runs(read(spark, d, "events").select(F.col("event_type").alias("model_id"), "event_id", (F.col("value") > 50).alias("failed")), "event_id", "failed")


@query(f"{RANK_SQL} SELECT rank, qa_id, CASE WHEN \"group\" = 'B' THEN 96 ELSE 32 END AS max_tokens, 'Answer.' || chr(10) || chr(10) || question AS prompt FROM ranked WHERE rank % 2 = 1")
def run_plan(spark, d):
    """P16, P21, F7, X6."""
    ranked = items.rank_by_hash(qa_items(spark, d))
    return runs.plan(ranked, None, runs.RunOptions(shard=1, num_shards=2, instruction="Answer.")).select("rank", "qa_id", "max_tokens", "prompt")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def worst_first(spark, d):
    """O1-O3: the largest few."""
    return items.largest(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 10)


@query()
def exact_shuffle(spark, d):
    """W3 in the exact mode: a seeded permutation. Its SQL would need the number of items, so tests hold it against the shuffle itself."""
    return items.rank_by_shuffle(qa_items(spark, d)).select("rank", "qa_id")
