"""Schemas of the tables an exchange is made of."""

from pyspark.sql import types as T

STEP = "global_step"
INDEX = "global_index"
KEY = [STEP, INDEX]

# Production status of a field (fixed values).
NOT_PRODUCED = 0
READY = 1

FIELD_META = T.StructType(
    [
        T.StructField("dtype", T.StringType()),
        T.StructField("shape", T.ArrayType(T.IntegerType())),
        T.StructField("production_status", T.ByteType()),
    ]
)

FIELD_MAP = T.MapType(T.StringType(), FIELD_META)

# One row per written cell. Presence means "produced".
PRODUCTION = T.StructType(
    [
        T.StructField(STEP, T.LongType()),
        T.StructField(INDEX, T.LongType()),
        T.StructField("field", T.StringType()),
        T.StructField("field_pos", T.IntegerType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("shape", T.ArrayType(T.IntegerType())),
        T.StructField("put_seq", T.LongType()),
        T.StructField("write_pos", T.LongType()),
    ]
)

# One row per (task, row) handed out; carries the batch it was handed out in.
CLAIMS = T.StructType(
    [
        T.StructField("task_name", T.StringType()),
        T.StructField(STEP, T.LongType()),
        T.StructField(INDEX, T.LongType()),
        T.StructField("claim_seq", T.LongType()),
        T.StructField("batch_index", T.LongType()),
    ]
)

# One row per put (claim) and block of addresses, for each field (task): the block's rows as a bitmap.
BITMAPS = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField(STEP, T.LongType()),
        T.StructField(INDEX, T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("bits", T.LongType()),
    ]
)

# One row per cleared step and clear.
CLEARS = T.StructType([T.StructField(STEP, T.LongType()), T.StructField("clear_seq", T.LongType())])

# One row per field name: its Spark type, fixed by the first put that brings it.
FIELDS = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("type_ddl", T.StringType()),
        T.StructField("put_seq", T.LongType()),
        T.StructField("field_pos", T.IntegerType()),
    ]
)

# One row per row address of a batch.
META = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("batch_index", T.LongType()),
        T.StructField(STEP, T.LongType()),
        T.StructField(INDEX, T.LongType()),
        T.StructField("fields", FIELD_MAP),
    ]
)
