"""RSS and Atom documents as the feed rows that ingest reads.

One schema serves the three layouts: entries are channel/item (RSS 2), item (RSS 1) or entry (Atom) below the root.
A document that is not well-formed or no feed gives a row without entries that says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINK = "struct<_VALUE:string,_href:string,_url:string,_type:string,_rel:string>"
ENTRY = f"""struct<title:string,link:array<{LINK}>,description:string,summary:string,`content:encoded`:string,content:string,pubDate:string,
    `dc:date`:string,published:string,updated:string,`media:content`:array<struct<_url:string>>,enclosure:array<{LINK}>>"""
DOCUMENT = f"channel struct<item:array<{ENTRY}>>, item array<{ENTRY}>, entry array<{ENTRY}>"
#: The date layouts of feeds behind the day's name; ISO times come first.
LAYOUTS = ["d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm z", "d MMM yyyy HH:mm xx", "d MMM yyyy"]


def documents(reader, landing: str) -> DataFrame:
    """source_id, xml and landed (a time) of the files <landing>/<source_id>/<name>, by spark.read or spark.readStream."""
    files = reader.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(landing)
    return files.select(F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1).alias("source_id"), F.col("value").alias("xml"), F.col("_metadata.file_modification_time").alias("landed"))


def moment(text: Column) -> Column:
    """A feed's time, null if it is none."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{2,9},\s*", "")
    return F.coalesce(F.try_to_timestamp(plain), *[F.try_to_timestamp(plain, F.lit(layout)) for layout in LAYOUTS])


def _entry(e: Column) -> Column:
    filled = lambda c: F.when(F.trim(c) != "", c)
    place = lambda x: F.coalesce(filled(x["_href"]), filled(x["_url"]), filled(x["_VALUE"]))
    main = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    typed = lambda links: F.transform(links, lambda x: F.struct(x["_href"].alias("href"), x["_url"].alias("url"), x["_type"].alias("type")))
    content = F.coalesce(e["content:encoded"], e["content"])
    return F.struct(
        F.trim(place(F.get(main, F.lit(0)))).alias("link"), e["title"].alias("title"), F.when(content.isNotNull(), F.array(F.struct(content.alias("value")))).alias("content"),
        F.coalesce(e["description"], e["summary"]).alias("summary"), moment(F.coalesce(e["pubDate"], e["published"], e["dc:date"])).alias("published"), moment(e["updated"]).alias("updated"),
        F.transform(e["media:content"], lambda m: F.struct(m["_url"].alias("url"))).alias("media_content"), typed(e["enclosure"]).alias("enclosures"), typed(e["link"]).alias("links"),
    )


def feed_rows(landed: DataFrame) -> DataFrame:
    """source_id, entries, in their order, and problem of documents (source_id, xml, ...); other columns stay. problem is null for a feed, if one without entries."""
    parsed = landed.withColumn("_d", F.from_xml("xml", f"{DOCUMENT}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    rooted = F.regexp_like("xml", F.lit(r"<(?:\w+:)?(?:rss|feed|RDF)[\s>]"))
    problem = F.when(~F.coalesce(F.regexp_like("xml", F.lit(r"\S")), F.lit(False)), "empty").when(F.col("_d._corrupt_record").isNotNull(), "not well-formed").when(~rooted, "no feed")
    entries = F.when(F.col("problem").isNull(), F.transform(F.coalesce("_d.channel.item", "_d.item", "_d.entry"), _entry))
    return parsed.withColumn("problem", problem).withColumn("entries", entries).drop("_d")
