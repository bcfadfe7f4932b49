"""Algebra on batch metadata."""

from pyspark.sql import functions as F

from rowrelay.functions import fieldmaps as FM
from rowrelay.operators import batch as BA
from rowrelay.plans.queries.registry import DOC_CTE, META_CTE, query
from rowrelay.schema import KEY, STEP
from rowrelay.sources import bindings as B


def _rendered(meta, *columns):
    return meta.select(*columns, FM.render_fields(F.col("fields")).alias("fields"))


def _infos(spark, sf_dir):
    """Attributes per step: two sources of the same batch with one key in common."""
    docs = B.doc_rows(spark, sf_dir)
    per_step = docs.groupBy(STEP).agg(
        F.min("lang").alias("low"), F.max("lang").alias("high"), F.count(F.lit(1)).cast("string").alias("n")
    )
    return per_step.select(
        F.col(STEP).alias("batch_id"),
        F.create_map(F.lit("lang"), F.col("low"), F.lit("rows"), F.col("n")).alias("a"),
        F.create_map(F.lit("lang"), F.col("high"), F.lit("kind"), F.lit("other")).alias("b"),
    )


_INFO_CTE = DOC_CTE + """,
info AS (SELECT global_step AS batch_id, min(lang) AS low, max(lang) AS high, CAST(count(*) AS VARCHAR) AS n
         FROM doc GROUP BY 1)"""


@query(
    "e1_from_samples",
    """WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS bi FROM conversations)
SELECT conv_id AS batch_id, turn, CAST(bi AS BIGINT) AS batch_index FROM c""",
)
def e1_from_samples(spark, sf_dir):
    turns = B.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("batch_id"), "turn", (-F.col("turn")).alias("_newest")
    )
    return BA.from_samples(turns, "_newest").drop("_newest")


@query(
    "e1_from_samples_sparse",
    """SELECT CAST(user_id % 3 AS BIGINT) AS batch_id, event_id,
CAST(row_number() OVER (PARTITION BY user_id % 3 ORDER BY epoch_us(ts), event_id) - 1 AS BIGINT) AS batch_index FROM events""",
)
def e1_from_samples_sparse(spark, sf_dir):
    """Events in the order of their times in microseconds, far apart, made unique by the number of the event."""
    events = B.table(spark, sf_dir, "events")
    moment = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select((F.col("user_id") % 3).cast("bigint").alias("batch_id"), "event_id", (moment * 1000 + F.col("event_id") % 1000).alias("_at"))
    return BA.from_samples(rows, "_at").drop("_at")


@query(
    "e2_empty",
    f"""WITH {META_CTE} SELECT batch_id, batch_index, global_step, global_index, CAST(3 AS INTEGER) AS n_fields,
true AS empty_is_ready FROM meta""",
)
def e2_empty(spark, sf_dir):
    """An empty batch is ready and adds nothing to the batches it is appended to."""
    none = BA.empty(spark)
    meta = B.doc_meta(spark, sf_dir).unionByName(none)
    ready = BA.batch_is_ready(none).scalar()
    return meta.select("batch_id", "batch_index", *KEY, F.size("fields").alias("n_fields"), ready.alias("empty_is_ready"))


@query("e3_size", "SELECT conv_id AS batch_id, count(*) AS size FROM conversations GROUP BY 1")
def e3_size(spark, sf_dir):
    return BA.size(B.table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "batch_id"))


@query("e4_global_indexes", f"WITH {META_CTE} SELECT batch_id, batch_index, global_index FROM meta")
def e4_global_indexes(spark, sf_dir):
    return BA.global_indexes(B.doc_meta(spark, sf_dir), ordered=True)


@query("e5_field_names", f"WITH {META_CTE} SELECT DISTINCT batch_id, 'n_chars,quality,text' AS field_names FROM meta")
def e5_field_names(spark, sf_dir):
    names = BA.field_names(B.doc_meta(spark, sf_dir))
    return names.withColumn("field_names", F.array_join("field_names", ","))


@query("e6_is_ready", f"WITH {META_CTE} SELECT batch_id, bool_and(labelled) AS is_ready FROM meta GROUP BY 1")
def e6_is_ready(spark, sf_dir):
    return BA.is_ready(B.doc_meta(spark, sf_dir))


@query(
    "e7_sample_predicates",
    f"""WITH {META_CTE} SELECT batch_id, batch_index, 'n_chars,quality,text' AS field_names, true AS has_text,
false AS has_score, labelled AS quality_ready, false AS score_ready, labelled AS row_ready,
CASE WHEN labelled THEN 'int' END AS quality_dtype,
CAST(CASE WHEN labelled THEN 1 ELSE 0 END AS TINYINT) AS quality_status FROM meta""",
)
def e7_sample_predicates(spark, sf_dir):
    f = F.col("fields")
    return B.doc_meta(spark, sf_dir).select(
        "batch_id",
        BA.batch_index_or_default(F.col("batch_index")).alias("batch_index"),
        F.array_join(F.array_sort(FM.field_names(f)), ",").alias("field_names"),
        FM.has_field(f, "text").alias("has_text"),
        FM.has_field(f, "score").alias("has_score"),
        FM.is_field_ready(f, "quality").alias("quality_ready"),
        FM.is_field_ready(f, "score").alias("score_ready"),
        FM.is_row_ready(f).alias("row_ready"),
        FM.get_field(f, "quality")["dtype"].alias("quality_dtype"),
        FM.production_status(f)["quality"].alias("quality_status"),
    )


@query(
    "e8_add_fields",
    f"""WITH {META_CTE} SELECT batch_id, batch_index, global_index,
'n_chars:bigint:[]:1,quality:bigint:[]:1,score:bigint:[]:1,text:-:-:1' AS fields FROM meta""",
)
def e8_add_fields(spark, sf_dir):
    data = B.doc_rows(spark, sf_dir).select(
        F.col(STEP).alias("batch_id"),
        (F.col("doc_id") - F.col(STEP) * 40).alias("batch_index"),
        F.length("text").cast("bigint").alias("score"),
        F.col("n_chars").alias("quality"),
    )
    meta = BA.add_fields(B.doc_meta(spark, sf_dir), data, ["score", "quality"])
    return _rendered(meta, "batch_id", "batch_index", "global_index")


@query(
    "e9_union",
    f"""WITH {META_CTE} SELECT batch_id, batch_index, global_index,
'n_chars:bigint:[]:1,quality:int:[]:1,score:-:-:1,text:-:-:1' AS fields FROM meta""",
)
def e9_union(spark, sf_dir):
    meta = B.doc_meta(spark, sf_dir)
    scalar = F.array().cast("array<int>")
    null = F.lit(None)
    fields = F.create_map(
        F.lit("quality"), FM.field_meta(F.lit("int"), scalar, F.lit(1)),
        F.lit("score"), FM.field_meta(null, null, F.lit(1)),
    )
    other = meta.withColumn("fields", fields).withColumn("batch_index", 39 - F.col("batch_index"))
    return _rendered(BA.union(meta, other), "batch_id", "batch_index", "global_index")


@query(
    "e9_union_slots",
    f"""WITH {META_CTE} SELECT global_step, global_index, 'quality:step ' || global_step || ':[]:1' AS fields FROM meta""",
)
def e9_union_slots(spark, sf_dir):
    """Steps that share a slot of the ring in one batch: a row gets the fields of its own step."""
    meta = B.doc_meta(spark, sf_dir)
    place = F.col(STEP) * 40 + F.col("batch_index")
    one = meta.withColumn("batch_id", F.pmod(STEP, F.lit(8).cast("bigint"))).withColumn("batch_index", place)
    shape = F.array().cast("array<int>")
    theirs = F.create_map(F.lit("quality"), FM.field_meta(F.concat(F.lit("step "), F.col(STEP).cast("string")), shape, F.lit(1)))
    mine = F.create_map(F.lit("quality"), FM.field_meta(F.lit("old"), shape, F.lit(1)))
    both = BA.union(one.withColumn("fields", mine), one.withColumn("fields", theirs))
    return _rendered(both, *KEY)


_FACTS_CTE = f"""{META_CTE},
facts AS (SELECT global_step AS batch_id, count(*) AS n, min(source) AS low, max(source) AS high, sum(n_chars) AS chars,
                 bool_or(taken) AS any_taken FROM doc GROUP BY 1)"""


def _info(spark, sf_dir, **entries):
    """Attributes of the document batches; an entry that is NULL for a batch is left out."""
    docs = B.doc_rows(spark, sf_dir).groupBy(F.col(STEP).alias("batch_id")).agg(*[c.cast("string").alias(k) for k, c in entries.items()])
    pairs = F.create_map(*[x for k in entries for x in (F.lit(k), F.col(k))])
    return docs.select("batch_id", F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("extra_info"))


def _info_text(info, *columns):
    entries = F.transform(F.array_sort(F.map_entries("extra_info")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return info.select(*columns, F.array_join(entries, ",").alias("extra_info"))


def _two_infos(spark, sf_dir):
    left = _info(spark, sf_dir, rows=F.count(F.lit(1)), source=F.min("source"))
    foreign = F.when(F.bool_or(F.col("lang") != "en"), F.lit("yes"))
    return left, _info(spark, sf_dir, source=F.max("source"), chars=F.sum("n_chars"), foreign=foreign)


@query(
    "e9_union_info",
    f"""WITH {_FACTS_CTE} SELECT batch_id, 'chars=' || chars || CASE WHEN any_taken THEN ',foreign=yes' ELSE '' END
|| ',rows=' || n || ',source=' || high AS extra_info FROM facts""",
)
def e9_union_info(spark, sf_dir):
    return _info_text(BA.union_info(*_two_infos(spark, sf_dir)), "batch_id")


@query(
    "e10_concat_info",
    f"""WITH {_FACTS_CTE} SELECT batch_id, 'chars=' || chars || CASE WHEN any_taken THEN ',foreign=yes' ELSE '' END
|| ',rows=' || n || ',source=' || low AS extra_info FROM facts""",
)
def e10_concat_info(spark, sf_dir):
    left, right = _two_infos(spark, sf_dir)
    parts = left.withColumn("part_no", F.lit(0)).union(right.withColumn("part_no", F.lit(1)))
    return _info_text(BA.concat_info(parts), "batch_id")


@query(
    "e11_chunk_info",
    f"""WITH {_FACTS_CTE} SELECT batch_id, CAST(c AS BIGINT) AS chunk_id, 'rows=' || n || ',source=' || low AS extra_info
FROM facts, range(3) AS r(c)""",
)
def e11_chunk_info(spark, sf_dir):
    return _info_text(BA.chunk_info(_two_infos(spark, sf_dir)[0], 3), "batch_id", "chunk_id")


@query(
    "e10_concat",
    f"""WITH {META_CTE}, m AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY batch_index) - 1 AS p,
0 AS part FROM meta WHERE labelled UNION ALL SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY batch_index) - 1, 1
FROM meta WHERE NOT labelled)
SELECT batch_id, global_index, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY part, p) - 1 AS BIGINT) AS batch_index
FROM m""",
)
def e10_concat(spark, sf_dir):
    """Labelled rows first, the others after them, each part numbered on its own before."""
    meta = B.doc_meta(spark, sf_dir).withColumnRenamed("batch_index", "_old")
    ready = FM.is_row_ready(F.col("fields"))
    first = BA.from_samples(meta.filter(ready), "_old").withColumn("part_no", F.lit(0))
    second = BA.from_samples(meta.filter(~ready), "_old").withColumn("part_no", F.lit(1))
    return BA.concat_parts(first.unionByName(second)).select("batch_id", "global_index", "batch_index")


@query(
    "e10_concat_list",
    f"""WITH {META_CTE}, o AS (SELECT *, row_number() OVER (ORDER BY batch_id, batch_index) - 1 AS p FROM meta)
SELECT global_step, global_index, p + (SELECT count(*) FROM meta) * part AS batch_index FROM o, range(2) AS t(part)""",
)
def e10_concat_list(spark, sf_dir):
    """All rows as one batch, concatenated with itself."""
    meta = B.doc_meta(spark, sf_dir)
    order = F.col("batch_id") * 40 + F.col("batch_index")
    one = meta.withColumn("_order", order).withColumn("batch_id", F.lit(0).cast("bigint")).drop("batch_index")
    whole = BA.from_samples(one, "_order").drop("_order")
    return BA.concat([whole, whole]).select(*KEY, "batch_index")


_CHUNKS = """t AS (SELECT conv_id AS batch_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS bi
FROM conversations),
ch AS (SELECT *, ntile(3) OVER (PARTITION BY batch_id ORDER BY bi) - 1 AS chunk_id FROM t)"""


@query(
    "e11_chunk",
    f"""WITH {_CHUNKS} SELECT batch_id, turn, CAST(chunk_id AS BIGINT) AS chunk_id,
CAST(row_number() OVER (PARTITION BY batch_id, chunk_id ORDER BY bi) - 1 AS BIGINT) AS batch_index FROM ch""",
)
def e11_chunk(spark, sf_dir):
    turns = B.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("batch_id"), "turn")
    return BA.chunk(BA.from_samples(turns, "turn"), 3)


@query(
    "e11_chunk_sizes",
    f"""WITH {_CHUNKS}, b AS (SELECT DISTINCT batch_id FROM t)
SELECT b.batch_id, CAST(r.c AS BIGINT) AS chunk_id, count(ch.turn) AS size
FROM b CROSS JOIN range(3) AS r(c) LEFT JOIN ch ON ch.batch_id = b.batch_id AND ch.chunk_id = r.c GROUP BY 1, 2""",
)
def e11_chunk_sizes(spark, sf_dir):
    turns = B.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("batch_id"), "turn")
    return BA.chunk_sizes(turns, 3)


@query(
    "e11_chunk_concat",
    f"WITH {META_CTE} SELECT batch_id, batch_index, global_index FROM meta",
)
def e11_chunk_concat(spark, sf_dir):
    """Chunking and concatenating the chunks gives back the batch."""
    chunks = BA.chunk(B.doc_meta(spark, sf_dir), 7)
    return BA.concat_parts(chunks, "chunk_id").select("batch_id", "batch_index", "global_index")


@query(
    "e12_reorder",
    f"WITH {META_CTE} SELECT batch_id, CAST(39 - batch_index AS BIGINT) AS batch_index, global_index FROM meta",
)
def e12_reorder(spark, sf_dir):
    meta = B.doc_meta(spark, sf_dir)
    order = meta.select("batch_id", (39 - F.col("batch_index")).alias("batch_index"), F.col("batch_index").alias("old_index"))
    return BA.reorder(meta, order).select("batch_id", "batch_index", "global_index")


@query(
    "e13_getitem",
    f"""WITH {META_CTE} SELECT batch_id, CAST(0 AS BIGINT) AS batch_index, global_index, item FROM (
SELECT batch_id, global_index, 0 AS item FROM meta WHERE batch_index = 0
UNION ALL SELECT batch_id, global_index, -2 FROM meta WHERE batch_index = 38)""",
)
def e13_getitem(spark, sf_dir):
    meta = B.doc_meta(spark, sf_dir)
    parts = [BA.getitem(meta, i).withColumn("item", F.lit(i)) for i in (0, -2)]
    return parts[0].unionByName(parts[1]).select("batch_id", "batch_index", "global_index", "item")


@query(
    "e14_extra_info",
    f"""WITH {_INFO_CTE} SELECT batch_id, low AS got, 'none' AS got_default, 'x' AS after_set, high AS after_update,
false AS has_removed, CAST(0 AS INTEGER) AS n_cleared, true AS has_rows, CAST(2 AS INTEGER) AS n_all,
low AS concat_lang, n AS concat_rows, high AS union_lang, 'other' AS union_kind FROM info""",
)
def e14_extra_info(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _infos(spark, sf_dir).select(
        "batch_id",
        BA.get_extra_info(a, "lang").alias("got"),
        BA.get_extra_info(a, "missing", "none").alias("got_default"),
        BA.get_extra_info(BA.set_extra_info(a, "lang", "x"), "lang").alias("after_set"),
        BA.get_extra_info(BA.update_extra_info(a, b), "lang").alias("after_update"),
        BA.has_extra_info(BA.remove_extra_info(a, "lang"), "lang").alias("has_removed"),
        F.size(BA.clear_extra_info(a)).alias("n_cleared"),
        BA.has_extra_info(a, "rows").alias("has_rows"),
        F.size(a).alias("n_all"),
        BA.get_extra_info(BA.concat_extra_info([a, b]), "lang").alias("concat_lang"),
        BA.get_extra_info(BA.concat_extra_info([a, b]), "rows").alias("concat_rows"),
        BA.get_extra_info(BA.union_extra_info(a, b), "lang").alias("union_lang"),
        BA.get_extra_info(BA.union_extra_info(a, b), "kind").alias("union_kind"),
    )


@query(
    "e15_extract_field_metas",
    """SELECT CAST(vec_id // 100 AS BIGINT) AS batch_id, CAST(vec_id % 100 AS BIGINT) AS batch_index,
'embedding:float:[' || len(embedding) || ']:1,label:int:[]:1,name:-:-:1,positive:float:['
|| len(list_filter(embedding, lambda x: x > 0)) || ']:1' AS fields FROM embeddings""",
)
def e15_extract_field_metas(spark, sf_dir):
    meta = BA.extract_field_metas(B.tensor_rows(spark, sf_dir), ["embedding", "positive", "label", "name"])
    return _rendered(meta, "batch_id", "batch_index")


@query(
    "e16_layout_report",
    """WITH b AS (SELECT CAST(vec_id // 100 AS BIGINT) AS batch_id, len(embedding) AS d,
len(list_filter(embedding, lambda x: x > 0)) AS p FROM embeddings),
g AS (SELECT batch_id, count(*) AS rows, min(d) = max(d) AS de, min(p) = max(p) AS pe FROM b GROUP BY 1)
SELECT batch_id, rows, f.field, CASE f.field WHEN 'name' THEN 'non-tensor' WHEN 'label' THEN 'dense'
WHEN 'embedding' THEN CASE WHEN de THEN 'dense' ELSE 'ragged' END ELSE CASE WHEN pe THEN 'dense' ELSE 'ragged' END END AS layout
FROM g, (VALUES ('embedding'), ('positive'), ('label'), ('name')) AS f(field)""",
)
def e16_layout_report(spark, sf_dir):
    return BA.layout_report(B.tensor_rows(spark, sf_dir), ["embedding", "positive", "label", "name"])


@query(
    "e16_layout_report_documents",
    f"""WITH {DOC_CTE}, g AS (SELECT global_step AS batch_id, count(*) AS rows, bool_and(quality IS NOT NULL) AS whole
FROM doc GROUP BY 1)
SELECT batch_id, rows, f.field, CASE WHEN f.field = 'n_chars' THEN 'dense' WHEN f.field = 'text' THEN 'non-tensor'
WHEN whole THEN 'dense' ELSE 'non-tensor' END AS layout FROM g, (VALUES ('text'), ('n_chars'), ('quality')) AS f(field)""",
)
def e16_layout_report_documents(spark, sf_dir):
    labels = B.table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = B.doc_rows(spark, sf_dir).join(labels, "doc_id", "left").withColumnRenamed(STEP, "batch_id")
    return BA.layout_report(rows, ["text", "n_chars", "quality"])
