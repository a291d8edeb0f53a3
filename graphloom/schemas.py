"""Explicit schemas of the graph tables; nothing is inferred."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _table(spec: str) -> StructType:
    kinds = {"s": StringType(), "i": IntegerType(), "l": LongType(), "d": DoubleType()}
    return StructType([StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


NODES = _table("id:s type:s name:s file_path:s line_start:i line_end:i summary:s documentation:s tags:s complexity:s language_notes:s layer_id:s package_id:s")
EDGES = _table("id:l source:s target:s type:s direction:s weight:d metadata:s")
FILES = _table("path:s content_hash:s size:l modified_at:l indexed_at:l node_count:i errors:s")
LAYERS = _table("id:s name:s description:s node_ids:s")
TOUR_STEPS = _table("order_index:i title:s description:s node_ids:s")
META = _table("key:s value:s")
TABLES = {"nodes": NODES, "edges": EDGES, "files": FILES, "layers": LAYERS, "tour_steps": TOUR_STEPS, "meta": META}

_named = lambda *names: StructType([StructField(n, StringType()) for n in names])
DOCUMENTATION = StructType(
    [
        StructField("version", IntegerType()),
        StructField("hasJsDoc", BooleanType()),
        StructField("description", StringType()),
        StructField("params", ArrayType(_named("name", "description"))),
        StructField("returns", StringType()),
        StructField("tags", ArrayType(_named("name", "text", "subject"))),
        StructField("declarationForm", StringType()),
    ]
)
