"""Sources: delimited, JSON lines and GeoJSON files, and the text and links of HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy


def addresses_csv(spark: SparkSession, path: str, parts: tuple[str, ...] = (), sep: str | None = None) -> DataFrame:
    """SRC-05: a headed file of address points, its separator a tab if the header has one, else |. The address is put together
    from its parts; rows whose coordinates are no numbers are left out."""
    if sep is None:
        sep = "\t" if "\t" in spark.read.text(path).first()[0] else "|"
    rows = spark.read.csv(path, sep=sep, header=True)
    rows = rows.withColumns({c: F.expr(f"try_cast({c} AS double)") for c in ("latitude", "longitude")})
    if parts:
        rows = rows.withColumn("address", F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in parts]))
    return rows.where("latitude IS NOT NULL AND longitude IS NOT NULL")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: lines of text files."""
    return spark.read.text(path)


def _polygons(features: DataFrame) -> DataFrame:
    """A row for each polygon of `geometry` (type, coordinates as JSON), with its properties and outer ring."""
    one = F.array(F.from_json("geometry.coordinates", "array<array<array<double>>>"))
    many = F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")
    polygons = F.when(F.col("geometry.type") == "Polygon", one).when(F.col("geometry.type") == "MultiPolygon", many)
    rows = features.select("properties", F.explode(polygons).alias("rings"))
    return rows.select("properties", F.transform(F.get("rings", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).alias("ring"))


def geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: features, one on each line, so that a large layer is read in parallel."""
    return _polygons(spark.read.schema("properties string, geometry struct<type:string,coordinates:string>").json(path))


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC-16."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: a row for each polygon of feature collections: feature number, properties as JSON, the outer ring, and all rings, holes
    behind it. Other shapes are left out. Places of a collection that declares GDA94 are changed to GDA2020."""
    kind = "crs struct<properties:struct<name:string>>, features array<struct<properties:string,geometry:struct<type:string,coordinates:string>>>"
    old = F.coalesce(F.col("crs.properties.name").rlike(r"(?i)EPSG:+4283$"), F.lit(False))
    features = spark.read.schema(kind).json(path, multiLine=True).select(old.alias("old"), F.posexplode("features").alias("feature", "f"))
    shape, coordinates = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    rows = features.select("feature", "old", F.col("f.properties").alias("properties"), F.explode(F.when(shape == "Polygon", one).when(shape == "MultiPolygon", many)).alias("rings"))
    place = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    placed = F.transform("rings", lambda r: F.transform(r, place))
    changed = F.transform("rings", lambda r: F.transform(r, lambda p: geodesy.to_gda2020(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))
    rows = rows.withColumn("rings", F.when(F.col("old"), changed).otherwise(placed))
    return rows.select("feature", "properties", F.get("rings", F.lit(0)).alias("ring"), "rings")


class _Text(HTMLParser):
    BLOCKS = ("title", "h1", "h2", "h3", "p", "li")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: dict[str, list[str]] = {b: [] for b in self.BLOCKS}
        self.links: list[str] = []
        self.open: list[tuple[str, list[str]]] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "svg"):
            self.hidden += 1
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        if tag in self.texts:
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "svg"):
            self.hidden = max(0, self.hidden - 1)
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, got = self.open.pop()
                if text := " ".join("".join(got).split()):
                    self.texts[t].append(text)
                if t == tag:
                    break

    def handle_data(self, data):
        if not self.hidden:
            for _, got in self.open:
                got.append(data)

    def close(self):
        super().close()
        while self.open:
            self.handle_endtag(self.open[-1][0])


#: Pages whose texts and links are held at once.
PAGES = 200


def html_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """SRC-09: key, text (title, then headings, paragraphs and list items by tag, each string once) and all links of each page. Pages
    of an Arrow batch become Python strings one at a time, and results leave in small batches, so a worker holds little beside the batch."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, PAGES) for whole in batches for i in range(0, whole.num_rows, PAGES)):
            texts, links = [], []
            for source in batch.column("__html"):
                parser = _Text()
                parser.feed(source.as_py() or "")
                parser.close()
                texts.append("\n".join(dict.fromkeys(t for b in parser.BLOCKS for t in parser.texts[b])))
                links.append(list(dict.fromkeys(parser.links)))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string()), pa.array(links, pa.list_(pa.string()))], [key, "text", "links"])

    return pages.select(key, F.col(html).alias("__html")).mapInArrow(run, f"{key} {kind}, text string, links array<string>")


def yaml_entries(spark: SparkSession, path: str, indent: int = 0) -> DataFrame:
    """SRC-17: ordinal and fields (a map of texts) of the entries of a YAML list `- key: value`, whose dashes stand behind `indent`
    spaces. Files are cut at entries, so a large one is read by many tasks. Values may be quoted and go on over deeper lines;
    nested lists and maps stay text; what is only a key, as the line above the list, is no entry."""
    lead = " " * indent
    rows = spark.read.option("lineSep", f"\n{lead}- ").text(path).where(~F.col("value").rlike(r"\A(?:---|#[^\n]*|\s)*(?:[A-Za-z_][A-Za-z0-9_]*:\s*)?\z"))
    entry = F.regexp_replace("value", r"\A\s*- ", "")
    deep = indent + 2
    pairs = rf"(?:\A|\n {{{deep}}})([A-Za-z_][A-Za-z0-9_]*):[ ]*([^\n]*(?:\n {{{deep + 1},}}[^\n]*)*)"
    keys, values = (F.regexp_extract_all(entry, F.lit(pairs), F.lit(n)) for n in (1, 2))

    def plain(v):
        v = F.trim(F.regexp_replace(v, r"\s*\n\s*", " "))
        quoted = F.regexp_extract(v, r"^'(.*)'$", 1)
        double = F.regexp_extract(v, r'^"(.*)"$', 1)
        bare = F.trim(F.regexp_replace(v, r"\s+#.*$", ""))
        return F.when(v.rlike("^'.*'$"), F.replace(quoted, F.lit("''"), F.lit("'"))).when(v.rlike('^".*"$'), double).otherwise(F.nullif(F.when(bare.isin("~", "null"), "").otherwise(bare), F.lit("")))

    later = lambda i: F.array_contains(F.slice(keys, i + 2, F.size(keys)), F.get(keys, i))  # noqa: E731 - of a key that comes twice the last counts
    last = F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda i: ~later(i))
    pairs = F.transform(last, lambda i: F.struct(F.get(keys, i), F.get(F.transform(values, plain), i)))
    fields = F.when(F.size(keys) > 0, F.map_from_entries(pairs)).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))
    return rows.select(F.monotonically_increasing_id().alias("ordinal"), fields.alias("fields"))
