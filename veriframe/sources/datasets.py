"""Annotated image data sets as assets: COCO and YOLO layouts, format sniffing, and the ingest ledger's events.

Layout questions (which files, which folders) are answered on the driver from directory listings; everything that grows
with the data set is a DataFrame: annotations are exploded and joined with images, files are scanned as binary and text.
"""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadImageHeaderError, CorruptAnnotationError, IngestError, MissingAssetError
from ..functions.boxes import coco_box, yolo_box
from ..operators.probe import now
from ..operators.writer import EntryFile
from ..schemas import ANNOTATION
from ..scratch import materialize
from .images import EXTENSIONS, image_metadata
from .profile import file_digest

HINTS = {"COCO": "coco mscoco ms-coco".split(), "YOLO": "ultralytics yolo yolov5 yolov8".split()}
IMAGE_FOLDERS, SPLITS, YAML_NAMES = "images train val test".split(), "train val test images".split(), "data.yaml data.yml dataset.yaml".split()
LEDGER_NAME = ".veriframe_ingest_ledger.jsonl"
_YAML = (".yaml", ".yml")
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
ASSET_COLUMNS = ("asset_id", "file_path", "sha256", "format", "image_metadata", "annotations", "contributor_id", "timestamp")


def detect_format(path: str | Path, hint: str = "auto") -> str:
    """COCO or YOLO, by the hint or else by the layout."""
    word, p = (hint or "auto").strip().lower(), Path(path)
    named = next((kind for kind, words in HINTS.items() if word in words), None)
    if named is None and word not in ("auto", "detect"):
        raise IngestError(f"unknown format hint {hint!r}")
    if named is None and p.is_file():
        named = "COCO" if p.suffix.lower() == ".json" else "YOLO" if p.suffix.lower() in _YAML else None
    elif named is None:
        here = {x.name for x in p.iterdir()} if p.is_dir() else set()
        if here & set(YAML_NAMES[:2]) or (p / "labels").is_dir() and (p / "images").is_dir():
            named = "YOLO"
        elif any(f for folder in (p / "annotations", p) for f in folder.glob("*.json")):
            named = "COCO"
    if named is None:
        raise IngestError(f"{p} has neither a COCO nor a YOLO layout")
    return named


def coco_inputs(path: str | Path) -> list[Path]:
    """The annotations file and the image folder of a COCO data set given as folder or as file."""
    p = Path(path)
    if p.is_file():
        near = [d / "images" for d in p.parents[:2]]
        return [p, next((d for d in near if any(f.suffix.lower() in EXTENSIONS for f in d.rglob("*"))), p.parent)]
    files = [*sorted((p / "annotations").glob("*.json")), *sorted(p.glob("*.json"))]
    if not files:
        raise MissingAssetError(f"no annotations under {p}")
    return [files[0], next((p / n for n in IMAGE_FOLDERS if (p / n).is_dir()), p)]


def _images(spark: SparkSession, folder: Path) -> DataFrame:
    """(path, sha256, image_metadata, name) of the image files under a folder; name is relative to it."""
    pattern = "*.{" + ",".join(x for e in EXTENSIONS for x in (e[1:], e[1:].upper())) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(str(folder))
    plain = F.regexp_replace("path", "^file:/*", "/")
    named = files.select(plain.alias("path"), F.sha2("content", 256).alias("sha256"), image_metadata(F.col("content")).alias("image_metadata"))
    return named.withColumn("name", F.substring("path", F.lit(len(str(folder).rstrip("/")) + 2), F.length("path")))


def _checked(assets: DataFrame, strict: bool) -> DataFrame:
    """Assets with `bad_record`, why a row is unusable. Strict reads raise the first; others drop them."""
    if not strict:
        return assets.filter("bad_record is null").drop("bad_record")
    bad = assets.filter("bad_record is not null").select("bad_record").orderBy("bad_record").first()
    if bad:
        kind, _, text = bad["bad_record"].partition(": ")
        raise {"missing": MissingAssetError, "header": BadImageHeaderError}.get(kind, CorruptAnnotationError)(text)
    return assets.drop("bad_record")


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.cast("double"))


def read_coco(
    spark: SparkSession, annotations_json: str | Path, image_root: str | Path, contributor: str, strict: bool = False,
    keep_bad: bool = False
) -> DataFrame:
    """Assets of a COCO file: images left-joined with their usable annotations in file order, categories by id, the last of a
    repeated id. Images that are not on disk or can't be read are dropped, or raise in strict reads; unusable boxes are
    passed over in either."""
    path, root = Path(annotations_json), Path(image_root)
    if not path.is_file():
        raise MissingAssetError(f"no annotations file {path}")
    if not root.is_dir():
        raise MissingAssetError(f"no image folder {root}")
    # the document is parsed once; what it lists is a table of rows from then on
    doc = spark.read.text(str(path), wholetext=True).select(F.try_parse_json("value").alias("v"))
    lists = F.array(*(F.struct(
        F.lit(k).alias("part"), F.try_variant_get("v", f"$.{k}", "array<variant>").alias("rows")
    ) for k in ("images", "annotations", "categories")))
    listed = doc.select(
        F.col("v").isNotNull().alias("json"), F.explode(lists).alias("l")
    ).select("json", "l.part", F.posexplode_outer("l.rows").alias("at", "r"))
    every = materialize(listed.select("json", "part", "at", F.to_json("r").alias("r")), "coco")
    if every.filter("json").isEmpty():
        raise CorruptAnnotationError(f"{path} is no JSON")
    if every.filter("part = 'images' and at is not null").isEmpty():
        raise CorruptAnnotationError(f"{path} lists no images")
    rows = lambda key: every.filter((F.col("part") == key) & F.col("at").isNotNull()).select("at", F.try_parse_json("r").alias("r"))
    get = lambda k, kind: F.try_variant_get("r", f"$.{k}", kind)
    names = rows("categories").select(
        get("id", "int").alias("category_id"),
        F.struct("at", F.coalesce(get("name", "string"), F.concat(F.lit("class_"), get("id", "string"))).alias("name")).alias("n")
    )
    names = names.filter("category_id is not null").groupBy("category_id").agg(F.max("n").alias("n")).select("category_id", F.col("n.name").alias("class_name"))
    notes = rows("annotations").select(
        "at", get("image_id", "long").alias("image_id"), get("category_id", "int").alias("category_id"),
        coco_box(get("bbox", "array<double>")).alias("bbox")
    )
    if strict and not notes.filter("image_id is null").isEmpty():
        raise CorruptAnnotationError(f"{path} has an annotation without image_id")
    notes = notes.filter("bbox is not null and category_id is not null and image_id is not null").join(names, "category_id", "left")
    note = F.struct(
        "bbox", "category_id", F.coalesce("class_name", F.concat(F.lit("class_"), F.col("category_id").cast("string"))).alias("class_name"),
        F.lit(None).cast("array<array<double>>").alias("segmentation")
    )
    grouped = notes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("at", note.alias("note")))).alias("notes"))
    images = rows("images").select(
        F.col("at").alias("order"), get("id", "string").alias("id"), get("id", "long").alias("image_id"),
        get("file_name", "string").alias("name")
    )
    found = images.join(_images(spark, root), "name", "left").join(grouped, "image_id", "left")
    where = F.concat(F.lit(f"{root}/"), "name")
    bad = (
        F.when(F.col("id").isNull() | F.col("name").isNull(), F.lit("corrupt: an image entry has no id or file_name"))
        .when(F.col("path").isNull(), F.concat(F.lit("missing: "), where))
        .when(F.col("image_metadata.width").isNull(), F.concat(F.lit("header: "), where))
    )
    out = found.select(
        "order",
        F.concat(F.lit("coco-"), "id").alias("asset_id"),
        F.col("path").alias("file_path"),
        "sha256",
        F.lit("COCO").alias("format"),
        "image_metadata",
        F.coalesce(F.transform("notes", lambda x: x["note"]), F.array().cast(f"array<{ANNOTATION.simpleString()}>")).alias("annotations"),
        F.lit(contributor).alias("contributor_id"),
        F.lit(now()).alias("timestamp"),
        bad.alias("bad_record"),
    )
    return out if keep_bad else _checked(out, strict)


def find_yaml(root: Path) -> Path:
    found = [root / n for n in YAML_NAMES if (root / n).is_file()]
    if not found:
        raise MissingAssetError(f"no data.yaml under {root}")
    return found[0]


def load_yaml(path: Path) -> dict:
    try:
        spec = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    except yaml.YAMLError as e:
        raise CorruptAnnotationError(f"{path} is no YAML: {e}") from e
    except OSError as e:
        raise MissingAssetError(f"{path} can't be read: {e}") from e
    if not isinstance(spec, dict):
        raise CorruptAnnotationError(f"{path} is no mapping")
    return spec


def class_names(spec: dict) -> dict[int, str]:
    names = spec["names"] if "names" in spec else spec.get("nc_names")
    if isinstance(names, dict):
        return {int(k): str(v) for k, v in names.items()}
    if isinstance(names, list):
        return dict(enumerate(map(str, names)))
    if names is not None:
        raise CorruptAnnotationError("names must be a list or a mapping")
    n = spec.get("nc")
    return {k: f"class_{k}" for k in range(n)} if isinstance(n, int) and n >= 0 else {}


def image_folders(root: Path, yaml_path: Path, spec: dict) -> list[Path]:
    """Folders of the splits and the default one, in order, each once."""
    base = (yaml_path.parent / str(spec.get("path") or root)).resolve()
    found = []
    for value in map(spec.get, SPLITS):
        if not value or not isinstance(value, str):
            continue
        folder = (base / value).resolve()
        folder = folder.parent if folder.is_file() else folder
        if folder.name != "images" and (folder / "images").is_dir():
            folder = folder / "images"
        found.append(folder)
    found.append((root / "images").resolve())
    folders = list(dict.fromkeys(f for f in found if f.is_dir()))
    if not folders:
        raise MissingAssetError(f"no images folder under {root}")
    return folders


def labels_folder(images: Path) -> Path:
    """The labels folder of an images folder: its sibling, or the path with every part `images` replaced."""
    if images.name != "images" and "images" in images.parts:
        return Path(*("labels" if p == "images" else p for p in images.parts))
    return images.parent / "labels"


def _labels(spark: SparkSession, folder: Path) -> DataFrame:
    """(stem, label_sha256, rows, label_error): parsed label files under a folder, fields as numbers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(str(folder))
    plain = F.regexp_replace("path", "^file:/*", "/")
    stem = F.regexp_replace(F.substring(plain, F.lit(len(str(folder).rstrip("/")) + 2), F.length(plain)), r"\.txt$", "")
    lines = F.transform(F.split(F.decode("content", "UTF-8"), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    used = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    fields = F.transform(used, lambda x: F.transform(F.slice(F.split(x, r"\s+"), 1, 5), _number))
    wrong = F.exists(fields, lambda r: (F.size(r) < 5) | F.exists(r, lambda v: v.isNull()))
    return files.select(stem.alias("stem"), F.sha2("content", 256).alias("label_sha256"), fields.alias("rows"), F.when(wrong, plain).alias("label_error"))


def read_yolo(
    spark: SparkSession, root: str | Path, contributor: str, data_yaml: str | Path | None = None, strict: bool = False,
    keep_bad: bool = False
) -> DataFrame:
    """Assets of a YOLO data set, with `label_sha256`. An image in several split folders counts once, as of the first. One
    line that can't be read makes its whole image unusable; boxes without area are dropped."""
    root = Path(root).resolve()
    if root.suffix.lower() in _YAML and not root.is_dir():
        yaml_path, root = root, root.parent
    else:
        if not root.is_dir():
            raise MissingAssetError(f"no data set folder {root}")
        yaml_path = Path(data_yaml).resolve() if data_yaml else find_yaml(root)
    if not yaml_path.is_file():
        raise MissingAssetError(f"no data.yaml {yaml_path}")
    spec = load_yaml(yaml_path)
    names = class_names(spec)
    known = F.from_json(F.lit(json.dumps({str(k): v for k, v in names.items()})), "map<string,string>")
    parts = []
    for order, folder in enumerate(image_folders(root, yaml_path, spec)):
        images = _images(spark, folder).withColumn("stem", F.regexp_replace("name", r"\.[^./]*$", ""))
        labels = labels_folder(folder)
        if labels.is_dir():
            images = images.join(_labels(spark, labels), "stem", "left")
        else:
            images = images.withColumns({
                "label_sha256": F.lit(None).cast("string"), "rows": F.lit(None).cast("array<array<double>>"),
                "label_error": F.lit(None).cast("string")
            })
        parts.append(images.withColumn("order", F.lit(order)))
    every = reduce(DataFrame.unionByName, parts)
    first = every.groupBy("path").agg(F.min("order").alias("order")) if len(parts) > 1 else None
    every = every.join(first, ["path", "order"]) if first is not None else every
    w, h = F.col("image_metadata.width"), F.col("image_metadata.height")

    def note(r: Column) -> Column:
        kind = F.get(r, 0).cast("int")  # towards zero
        name = F.coalesce(F.try_element_at(known, kind.cast("string")), F.concat(F.lit("class_"), kind.cast("string")))
        box = yolo_box(*(F.get(r, k) for k in range(1, 5)), w, h)
        return F.struct(box.alias("bbox"), kind.alias("category_id"), name.alias("class_name"), F.lit(None).cast("array<array<double>>").alias("segmentation"))

    notes = F.filter(F.transform("rows", note), lambda a: (F.get(a["bbox"], 2) > 0) & (F.get(a["bbox"], 3) > 0))
    bad = F.when(w.isNull(), F.concat(F.lit("header: "), "path")).when(F.col("label_error").isNotNull(), F.concat(F.lit("corrupt: "), "label_error"))
    out = every.select(
        "order",
        F.concat(F.lit("yolo-"), F.regexp_extract("stem", "[^/]*$", 0)).alias("asset_id"),
        F.col("path").alias("file_path"),
        "sha256",
        F.lit("YOLO").alias("format"),
        "image_metadata",
        F.coalesce(notes, F.array().cast(f"array<{ANNOTATION.simpleString()}>")).alias("annotations"),
        F.lit(contributor).alias("contributor_id"),
        F.lit(now()).alias("timestamp"),
        "label_sha256",
        bad.alias("bad_record"),
    )
    return out if keep_bad else _checked(out, strict)


def ingest_events(assets: DataFrame) -> DataFrame:
    """(order, file_path, payload): the ledger events of assets, payload being JSON."""
    cols = [
        F.col("asset_id"), F.col("file_path"), F.col("format"), F.col("contributor_id"), F.col("sha256").alias("image_sha256"),
        F.size("annotations").alias("annotation_count")
    ]
    if "label_sha256" in assets.columns:
        cols.append(F.col("label_sha256"))
    return assets.select("order", "file_path", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("payload"))


def ingest(spark: SparkSession, path: str | Path, hint: str, contributor: str, ledger: str | None = None, strict: bool = False) -> DataFrame:
    """Assets of a data set; every asset and the data set itself are entered in the ledger, in order."""
    if not contributor:
        raise IngestError("a contributor is needed")
    p = Path(path).expanduser().resolve()
    if not p.exists():
        raise MissingAssetError(f"no data set {p}")
    kind = detect_format(p, hint)
    entries = EntryFile(ledger or str((p if p.is_dir() else p.parent) / LEDGER_NAME))
    if kind == "COCO":
        notes, root = coco_inputs(p)
        assets = read_coco(spark, notes, root, contributor, strict)
        about = {"format": kind, "annotations_json": str(notes), "annotations_sha256": file_digest(str(notes)), "image_root": str(root)}
    else:
        assets = read_yolo(spark, p, contributor, strict=strict)
        spec = p if p.is_file() else find_yaml(p)
        about = {"format": kind, "dataset_root": str(p if p.is_dir() else p.parent), "data_yaml": str(spec), "data_yaml_sha256": file_digest(str(spec))}
    count = 0

    def events():
        nonlocal count
        for r in ingest_events(assets).orderBy("order", "file_path").toLocalIterator():  # a chain is written in order
            count += 1
            yield "m0.ingest.asset", json.loads(r["payload"])

    entries.extend(events())
    entries.append("m0.ingest.dataset", about | {"asset_count": count, "contributor_id": contributor})
    return assets.select(*(c for c in (*ASSET_COLUMNS, "label_sha256") if c in assets.columns))
