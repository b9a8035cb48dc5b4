"""Label cleaning: per-image tags, support counts, class ids and alias mapping.

tags is a table (image, label); a label counts once per image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import json_candidate, normalize_label, parse_labels
from siftwell.operators.batch import with_position


def tags_from_text(df: DataFrame, image: str, text: str) -> DataFrame:
    """One row per image and distinct normalised label of a label list."""
    return df.select(F.col(image).alias("image"), F.explode(parse_labels(F.col(text))).alias("label")).distinct()


def tag_lists(tags: DataFrame) -> DataFrame:
    """Sorted labels per image, and the prompt that joins them."""
    lists = tags.groupBy("image").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return lists.withColumn("prompt", F.array_join("labels", ". "))


def support(tags: DataFrame) -> DataFrame:
    """Images per label."""
    return tags.select("image", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("support"))


def support_from_rows(rows: DataFrame, label: str, number: str) -> DataFrame:
    """The largest support per normalised label."""
    return rows.select(normalize_label(F.col(label)).alias("label"), number).where("label <> ''").groupBy("label").agg(F.max(number).alias("support"))


def class_table(tags: DataFrame) -> DataFrame:
    """class_id from 1 by falling support, then label, numbered by ranges so that no task sees the whole vocabulary."""
    rows = with_position(support(tags), F.desc("support"), F.col("label"), name="class_id")
    return rows.withColumn("class_id", (F.col("class_id") + 1).cast("int"))


def apply_mapping(tags: DataFrame, mapping: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Sorted distinct canonical labels per image: mapping has (label, canonical, known).

    Labels that the mapping lacks stay; a null canonical drops the label; an image whose labels
    all go keeps an empty list.
    """
    m = mapping.select(F.col("label").alias("_from"), F.col("canonical").alias("_to"), F.lit(True).alias("_known"))
    rows = tags.join(m, F.col("label") == F.col("_from"), "left").withColumn("label", F.when(F.col("_known"), F.col("_to")).otherwise(F.col("label")))
    lists = rows.groupBy("image").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    if images is None:
        return lists
    return images.join(lists, "image", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def clean_report(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: labels before and after, dropped ones, and alias groups of more than one label."""
    own = support(tags).join(mapping.withColumn("_known", F.lit(True)), "label", "left").withColumn("canonical", F.when(F.col("_known"), F.col("canonical")).otherwise(F.col("label")))
    groups = own.where("canonical IS NOT NULL").groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))
    return own.agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("canonical").isNull()).alias("dropped")).crossJoin(groups.agg(F.count(F.lit(1)).alias("canonical_labels"), F.count_if(F.col("n") > 1).alias("groups")))


def lookup_names(ids: DataFrame, classes: DataFrame, column: str = "class_id") -> DataFrame:
    """Class names by id; an unknown id is called class_{id}."""
    names = classes.select(F.col("class_id").alias("_id"), F.col("label").alias("_name"))
    return ids.join(names, F.col(column) == F.col("_id"), "left").withColumn("class_name", F.coalesce("_name", F.concat(F.lit("class_"), F.col(column).cast("string")))).drop("_id", "_name")


def number_instances(masks: DataFrame, classes: DataFrame, image: str, order: str, label: str) -> DataFrame:
    """Instances of known classes numbered from 1 per image in order; packed is class << 16 | instance."""
    known = masks.join(classes.select(F.col("label").alias("_l"), F.col("class_id")).where("class_id > 0"), F.col(label) == F.col("_l")).drop("_l")
    rows = known.withColumn("instance_id", F.row_number().over(Window.partitionBy(image).orderBy(order)))
    return rows.withColumn("packed", F.shiftleft(F.col("class_id"), 16).bitwiseOR(F.col("instance_id")))


def unpack(packed: str):
    """(class id, instance id) of a packed mask value."""
    return F.shiftright(F.col(packed), 16), F.col(packed).bitwiseAND(F.lit(0xFFFF))


def annotations(names: str, boxes: str, areas: str, scores: str):
    """Four parallel arrays as one array of structs; instance ids count from 1."""
    return F.expr(f"transform(arrays_zip({names}, {boxes}, {areas}, {scores}), (z, i) -> named_struct('instance_id', i + 1, 'class_name', z.{names}, 'bbox', z.{boxes}, 'mask_area', z.{areas}, 'score', z.{scores}))")


def vocabulary_json(classes: DataFrame) -> DataFrame:
    """One row: all labels with their support as a JSON list, for a cleaning prompt.  The vocabulary is small by nature."""
    return classes.groupBy().agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("s"), "label"))), lambda x: F.struct(x["label"].alias("label"), (-x["s"]).alias("support")))).alias("labels"))


def mapping_from_reply(reply: DataFrame, text: str, labels: DataFrame) -> DataFrame:
    """(label, canonical) for the labels that a model's JSON reply maps.

    Three shapes are read: a map of label to canonical; {"mapping": that map}; a list of
    {"label", "canonical"}.  drop, remove and discard mean null; labels that weren't asked about
    are ignored.
    """
    body = json_candidate(F.col(text))
    flat = F.from_json(body, "map<string, string>")
    nested = F.from_json(F.get_json_object(body, "$.mapping"), "map<string, string>")
    listed = F.from_json(body, "array<struct<label: string, canonical: string>>")
    pairs = F.when(F.substring(F.trim(body), 1, 1) == "[", F.transform(listed, lambda x: F.struct(x["label"].alias("key"), x["canonical"].alias("value")))).when(nested.isNotNull(), F.map_entries(nested)).otherwise(F.map_entries(flat))
    rows = reply.select(F.explode(pairs).alias("p")).select(normalize_label(F.col("p.key")).alias("label"), normalize_label(F.col("p.value")).alias("canonical"))
    rows = rows.join(labels.select("label").distinct(), "label", "left_semi")
    return rows.withColumn("canonical", F.when(~F.col("canonical").isin("drop", "remove", "discard", ""), F.col("canonical")))
