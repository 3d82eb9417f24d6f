"""Image dataset annotations as samples: sample_id, file_name, width, height, contributor, batch, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions.columns import base_name

BOX = "struct<x:double,y:double,width:double,height:double,category_id:int,category_name:string>"
COCO = (
    "images array<struct<id:long,file_name:string,width:int,height:int,contributor:string,source_contributor:string,batch_id:string,batch:string>>,"
    "annotations array<struct<id:long,image_id:long,category_id:int,bbox:array<double>>>, categories array<struct<id:int,name:string>>"
)
MANIFEST = (
    "dataset_name string, samples array<struct<sample_id:string,original_image:string,current_image:string,contributor:string,batch_id:string,attack_type:string,"
    "is_attacked:int,is_shifted:int,shift_type:string,original_label:string,modified_label:string,parameters:string,boxes:array<" + BOX + ">>>"
)


def _box(x: Column, y: Column, w: Column, h: Column, category: Column, name: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"), category.cast("int").alias("category_id"), name.alias("category_name"))


def coco(spark: SparkSession, path: str) -> DataFrame:
    """One row for each image with its boxes; unknown categories are called class_<id>. An explicit null alias counts as absent."""
    doc = spark.read.schema(COCO).option("multiLine", True).json(path)
    images = doc.select(F.explode("images").alias("i")).select("i.*")
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), "c.name")
    notes = doc.select(F.explode("annotations").alias("a")).select("a.*").join(F.broadcast(names), "category_id", "left")
    at = lambda k: F.get("bbox", k)
    box = _box(at(0), at(1), at(2), at(3), F.col("category_id"), F.coalesce("name", F.concat(F.lit("class_"), F.col("category_id"))))
    boxes = notes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", box.alias("b")))).alias("_b")).select("image_id", F.transform("_b", lambda e: e["b"]).alias("boxes"))
    joined = images.join(boxes, images.id == boxes.image_id, "left")
    return joined.select(F.col("id").cast("string").alias("sample_id"), "file_name", "width", "height", F.coalesce("contributor", "source_contributor").alias("contributor"), F.coalesce("batch_id", "batch").alias("batch"), F.coalesce("boxes", F.array().cast(f"array<{BOX}>")).alias("boxes"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each manifest sample, with its ground truth; flags may be numbers or booleans, paths may use either slash."""
    doc = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    s = doc.select(F.explode("samples").alias("s")).select("s.*")
    return s.withColumnRenamed("batch_id", "batch").withColumn("is_attacked", F.coalesce("is_attacked", F.lit(0)) != 0).withColumn("is_shifted", F.coalesce("is_shifted", F.lit(0)) != 0).withColumn("file_name", base_name(F.col("current_image"))).withColumn("width", F.lit(640)).withColumn("height", F.lit(640))


def yolo(spark: SparkSession, folder: str, width: int = 640, height: int = 640, names: dict[int, str] | None = None) -> DataFrame:
    """One row for each label file of a folder: lines of class and a box in [0, 1]; other lines are skipped and counted in rejected."""
    lines = spark.read.text(f"{folder}/*.txt").select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"\s+").alias("f"))
    number = lambda k: F.try_to_number(F.get("f", F.lit(k)), F.lit("9")) if k == 0 else F.get("f", k).try_cast("double")
    cls = F.get("f", 0).try_cast("int")
    cx, cy, w, h = (number(k) for k in (1, 2, 3, 4))
    unit = lambda c: F.coalesce((c >= 0) & (c <= 1), F.lit(False))
    good = (F.size("f") >= 5) & cls.isNotNull() & unit(cx) & unit(cy) & unit(w) & unit(h)
    known = F.create_map(*(F.lit(x) for kv in (names or {}).items() for x in kv)) if names else F.create_map().cast("map<int,string>")
    name = F.coalesce(F.try_element_at(known, cls), F.concat(F.lit("class_"), cls))
    box = _box((cx - w / 2) * width, (cy - h / 2) * height, w * width, h * height, cls, name)
    rows = lines.groupBy("path").agg(F.array_compact(F.collect_list(F.when(good, box))).alias("boxes"), F.count_if(~good & (F.array_join("f", "") != "")).alias("rejected"))
    rank = F.row_number().over(W.orderBy("path"))
    return rows.select(F.format_string("yolo_%d", rank - 1).alias("sample_id"), base_name(F.col("path")).alias("file_name"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(None).cast("string").alias("contributor"), F.lit(None).cast("string").alias("batch"), "boxes", "rejected")


def visdrone(spark: SparkSession, folder: str, sample: int | None = None, seed: int = 42) -> DataFrame:
    """One row for each annotation file of eight comma (else space) separated fields; categories 0 and 11 and score 0 are dropped."""
    lines = spark.read.text(f"{folder}/*.txt").select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("v"))
    f = F.when(F.contains("v", F.lit(",")), F.split("v", r"\s*,\s*")).otherwise(F.split("v", r"\s+"))
    at = lambda k, kind="double": F.get("f", k).try_cast(kind)
    good = F.coalesce((F.size("f") >= 6) & (at(4) != 0) & ~at(5, "int").isin(0, 11) & at(0).isNotNull() & at(1).isNotNull() & at(2).isNotNull() & at(3).isNotNull(), F.lit(False))
    box = _box(at(0), at(1), at(2), at(3), at(5, "int"), F.concat(F.lit("class_"), at(5, "int")))
    rows = lines.withColumn("f", f).groupBy("path").agg(F.array_compact(F.collect_list(F.when(good, box))).alias("boxes"))
    if sample is not None:
        rows = rows.orderBy(F.sha2(F.concat("path", F.lit(f":{seed}")), 256)).limit(sample)
    rank = F.row_number().over(W.orderBy("path"))
    return rows.select(F.format_string("visdrone_%05d", rank - 1).alias("sample_id"), base_name(F.col("path")).alias("file_name"), F.lit(640).alias("width"), F.lit(640).alias("height"), F.lit(None).cast("string").alias("contributor"), F.lit(None).cast("string").alias("batch"), "boxes")


def sniff(spark: SparkSession, path: str) -> str:
    """coco, manifest, yolo or visdrone, from one line or one document; JSON files are looked at in the order of their names."""
    if path.endswith(".json"):
        fields = spark.read.option("multiLine", True).json(path).schema
        if "samples" in fields.names:
            return "manifest"
        if "images" in fields.names:
            return "coco"
        raise ValueError(f"{path}: neither a manifest nor COCO")
    line = spark.read.text(f"{path}/*.txt").filter("trim(value) <> ''").first()
    return "visdrone" if line and line.value.count(",") >= 5 else "yolo"


def load(spark: SparkSession, path: str) -> DataFrame:
    return {"coco": coco, "manifest": manifest, "yolo": yolo, "visdrone": visdrone}[sniff(spark, path)](spark, path)


RECORD = (
    "record_id string, timestamp_utc double, nonce string, sequence_number long, image_hash_sha256 string, model_digest_sha256 string, preprocessing_config_hash string,"
    "predictions array<struct<box:array<double>,confidence:double,category_id:int,category_name:string>>, binding_hash_sha256 string, hmac_signature string"
)


def inference_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON object or array, with _corrupt_record where a text can't be read: a finding, not an error."""
    return spark.read.schema(f"{RECORD}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
