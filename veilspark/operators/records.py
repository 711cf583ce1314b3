"""Mail hops, spam reports, tracks, entities and words: jobs over tables of many records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: RFC 5322, date-time: day, month, year, time, zone.
_DATE = r"([0-9]{1,2} +(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +[0-9]{4} +[0-9]{2}:[0-9]{2}:[0-9]{2}) +([+-][0-9]{4})"
#: Mail servers as they name themselves in a comment, with a version or without.
WITH_VERSION, WITHOUT_VERSION = ("Exim", "Sendmail"), ("Postfix", "qmail", "Dovecot", "Haraka", "OpenSMTPD", "Zimbra", "Microsoft SMTP Server")


def headers(mails: DataFrame) -> DataFrame:
    """(mail_id, header_no, name, value): continuation lines joined."""
    unfolded = F.regexp_replace(F.regexp_replace("headers", "\r\n", "\n"), r"\n[ \t]+", " ")
    rows = mails.select("mail_id", F.posexplode(F.split(unfolded, "\n")).alias("header_no", "line")).where("instr(line, ':') > 1")
    return rows.select("mail_id", "header_no", F.substring_index("line", ":", 1).alias("name"), F.trim(F.expr("substr(line, instr(line, ':') + 1)")).alias("value"))


def _software(comments: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name in WITH_VERSION:
        version = F.regexp_extract(comments, rf"(?i)\b{name}[ /]([0-9]+(?:[.][0-9]+)*)", 1)
        out = out.when(version != "", F.concat(F.lit(f"{name} "), version))
    for name in WITHOUT_VERSION:
        out = out.when(comments.rlike(rf"(?i)\b{name}\b"), name)
    return out


def hops(mails: DataFrame) -> DataFrame:
    """(mail_id, hop_no from the sender on, from_host, by_host, at, zone, tls, protocol, software, ip, delay): delay in seconds, null if a time is missing.

    A trace line (RFC 5321, 4.4) is clauses of a word and its value (from, by, via, with, id, for), a semicolon and
    a date. Comments in parentheses may stand anywhere: the one after the sender's name has its address as a
    literal, others tell the software and the encryption. So clauses are read from the line without its comments.
    """
    v = F.col("value")
    for _ in range(3):  # a comment within a comment becomes a part of it
        v = F.regexp_replace(v, r"\(([^()]*)\(([^()]*)\)", "($1 $2 ")
    lines = headers(mails).where(F.lower("name") == "received").select("mail_id", "header_no", v.alias("v"))
    plain = F.regexp_replace("v", r"\([^()]*\)", " ")
    lines = lines.select("mail_id", "header_no", F.regexp_extract_all("v", F.lit(r"\([^()]*\)"), F.lit(0)).alias("c"), plain.alias("p"), F.regexp_extract("v", _DATE, 0).alias("d"))
    # Each text is a column before it is read, so that no expression is written out for every use.
    lines = lines.select("mail_id", "header_no", F.array_join("c", " ").alias("c"), F.concat(F.lit(" "), F.substring_index("p", ";", 1), F.lit(" ")).alias("p"), "d")

    def part(text: str, pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))

    zone = F.nullif(F.substring("d", -5, 5), F.lit(""))
    sign = F.when(F.substring("zone", 1, 1) == "-", -1).otherwise(1)
    offset = sign * (F.substring("zone", 2, 2).cast("int") * 3600 + F.substring("zone", 4, 2).cast("int") * 60)
    day = F.nullif(F.regexp_replace(F.regexp_extract("d", _DATE, 1), " +", " "), F.lit(""))
    at = F.timestamp_seconds(F.unix_timestamp(F.try_to_timestamp("day", F.lit("d MMM yyyy HH:mm:ss"))) - offset)
    rows = lines.withColumns({"zone": zone, "day": day, "software": _software(F.col("c"))}).select(
        "mail_id",
        "header_no",
        F.coalesce(part("p", r"(?i) from +(\S+)"), F.lit("unknown")).alias("from_host"),
        F.coalesce(part("p", r"(?i) by +(\S+)"), F.lit("unknown")).alias("by_host"),
        at.alias("at"),
        "zone",
        part("c", r"\b((?:TLS|SSL)v?[0-9](?:[.][0-9])?)\b").alias("tls"),
        F.upper(part("p", r"(?i) with +([A-Za-z][A-Za-z0-9-]*)")).alias("protocol"),
        "software",
        part("c", r"\[(?:IPv6:)?([0-9A-Fa-f.:]+)\]").alias("ip"),
    )
    order = W.partitionBy("mail_id").orderBy(F.col("header_no").desc())
    rows = rows.withColumn("hop_no", F.row_number().over(order)).withColumn("before", F.lag("at").over(order))
    return rows.withColumn("delay", (F.unix_timestamp("at") - F.unix_timestamp("before"))).drop("before", "header_no")


def delay_class(delay: Column) -> Column:
    return F.when(delay < 0, "clock").when(delay <= 10, "fast").when(delay <= 60, "normal").when(delay <= 300, "slow").when(delay > 300, "very slow")


def delay_text(delay: Column) -> Column:
    d = F.abs(delay)
    text = F.when(d < 60, F.concat(d.cast("string"), F.lit("s"))).when(d < 3600, F.concat(F.floor(d / 60).cast("string"), F.lit("m "), (d % 60).cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(d / 3600).cast("string"), F.lit("h "), F.floor(d % 3600 / 60).cast("string"), F.lit("m")))
    return F.when(delay < 0, F.concat(F.lit("-"), text)).otherwise(text)


def spam_symbols(mails: DataFrame) -> DataFrame:
    """(mail_id, engine, name, score) from both kinds of report."""
    one = F.explode(F.regexp_extract_all("headers", F.lit(r"([A-Z][A-Z0-9_]+)\(([-+]?\d+\.\d+)\)"), F.lit(0)))
    rspamd = mails.where(F.contains("headers", F.lit("X-Spamd-Result"))).select("mail_id", F.lit("rspamd").alias("engine"), one.alias("s"))
    rspamd = rspamd.select("mail_id", "engine", F.substring_index("s", "(", 1).alias("name"), F.regexp_extract("s", r"\(([-+]?\d+\.\d+)\)", 1).cast("double").alias("score"))
    row = F.explode(F.regexp_extract_all("headers", F.lit(r"(?m)^\s*([-+]?\d+\.\d+)\s+([A-Z][A-Z0-9_]+)"), F.lit(0)))
    table = mails.where(F.contains("headers", F.lit("Content analysis details"))).select("mail_id", F.lit("spamassassin").alias("engine"), row.alias("s"))
    table = table.select("mail_id", "engine", F.regexp_extract("s", r"([A-Z][A-Z0-9_]+)$", 1).alias("name"), F.regexp_extract("s", r"([-+]?\d+\.\d+)", 1).cast("double").alias("score"))
    return rspamd.unionByName(table)


def track_statistics(points: DataFrame) -> DataFrame:
    return points.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"),
        F.min("ele").alias("lowest"), F.max("ele").alias("highest"), ((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 60).alias("minutes"),
    )


def moved_tracks(points: DataFrame, lat: float, lon: float) -> DataFrame:
    """Points moved so that each track's centre is the target; longitudes wrap, latitudes are clamped; 6 decimals."""
    centre = points.groupBy("track_id").agg(F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    both = points.join(centre, "track_id")
    x, y = F.col("lon") + F.lit(lon) - F.col("c_lon"), F.col("lat") + F.lit(lat) - F.col("c_lat")
    return both.withColumn("lon", F.round(x - 360 * F.floor((x + 180) / 360), 6)).withColumn("lat", F.round(F.greatest(F.least(y, F.lit(90.0)), F.lit(-90.0)), 6)).drop("c_lat", "c_lon")


#: Boxes (south, north, west, east); the first that holds a point names its continent.
CONTINENTS = (("europe", 35, 72, -25, 45), ("asia", 0, 80, 45, 180), ("africa", -35, 37, -20, 52), ("north_america", 12, 84, -170, -50), ("south_america", -57, 13, -83, -34), ("oceania", -50, 0, 110, 180))


def continent(lat: Column, lon: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, s, n, w, e in CONTINENTS:
        out = out.when(lat.between(s, n) & lon.between(w, e), name)
    return out.otherwise("unknown")


def semicircles(raw: Column) -> Column:
    """Device units to degrees; null where there is no fix."""
    return F.when(raw != 0x7FFFFFFF, F.round(raw * (180.0 / 2**31), 6))


SENSORS = ("hr", "cad", "power", "temp", "ele", "ts")
#: Device values without a reading, and what lies outside a sensor's range.
RANGES = {"hr": (1, 254), "cad": (0, 254), "power": (0, 4000), "temp": (-60, 80)}


def without_columns(points: DataFrame, drop: tuple[str, ...] = (), blank: tuple[str, ...] = ()) -> DataFrame:
    """Points without some sensor columns, or with nulls in them; columns that are no sensor's are refused."""
    if other := {*drop, *blank} - set(SENSORS):
        raise ValueError(f"no sensor columns: {sorted(other)}")
    return points.drop(*drop).withColumns({c: F.lit(None).cast(points.schema[c].dataType) for c in blank if c in points.columns and c not in drop})


def in_range(points: DataFrame) -> DataFrame:
    """Points with nulls for readings outside their sensor's range."""
    return points.withColumns({c: F.when(F.col(c).between(*r), F.col(c)) for c, r in RANGES.items() if c in points.columns})


def altitude(raw: Column) -> Column:
    """Device units (fifths of a metre above -500 m) to metres; null for no reading."""
    return F.when((raw >= 0) & (raw < 0xFFFF), raw / 5.0 - 500.0)


def activity_summary(records_: DataFrame) -> DataFrame:
    """(track_id, type, n, has_place, has_hr, has_power) of an activity's record rows."""
    flags = {"has_place": F.col("lat").isNotNull() & F.col("lon").isNotNull(), "has_hr": F.col("hr").isNotNull(), "has_power": F.col("power").isNotNull()}
    return records_.groupBy("track_id", "type").agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(v).alias(k) for k, v in flags.items()])


def entities(tokens: DataFrame, least: float = 0.5) -> DataFrame:
    """Token rows (doc_id, token_no, label, word, score, start, end) merged to entities.

    B- opens an entity, I- of the same type goes on, anything else closes; ## pieces are glued. Islands are
    found with one running sum for each document. Mean score, length and shape decide what stays.
    """
    w = W.partitionBy("doc_id").orderBy("token_no")
    kind, mark = F.substring_index("label", "-", -1), F.substring("label", 1, 1)
    rows = tokens.withColumn("kind", kind).withColumn("mark", mark)
    goes_on = (F.col("mark") == "I") & (F.lag("kind").over(w) == F.col("kind")) & F.lag("mark").over(w).isin("B", "I")
    rows = rows.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("new").over(w)).where("mark <> 'O'")
    held = F.array_sort(F.collect_list(F.struct("token_no", "word")))
    text = F.replace(F.array_join(F.transform(held, lambda x: x["word"]), " "), F.lit(" ##"), F.lit(""))
    out = rows.groupBy("doc_id", "island").agg(F.first("kind").alias("kind"), text.alias("word"), F.avg("score").alias("score"), F.min("start").alias("start"), F.max("end").alias("end"))
    return out.where((F.col("score") >= least) & (F.length("word") >= 2) & ((F.col("end") - F.col("start")).between(1, 100))).drop("island")


def untouched(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of found (doc_id, start, end) that touch no span of the same document: a hash join with a range test."""
    a, b = found.alias("a"), spans.select("doc_id", "start", "end").alias("b")
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.start") < F.col("b.end")) & (F.col("a.end") > F.col("b.start")), "left_anti")


def page_texts(words: DataFrame) -> DataFrame:
    """Words (page_id, word_no, line_no, text) with their offsets in the page's text: blanks within lines, line feeds between."""
    w = W.partitionBy("page_id").orderBy("word_no")
    sep = F.when(F.lag("line_no").over(w).isNull(), "").when(F.lag("line_no").over(w) == F.col("line_no"), " ").otherwise("\n")
    rows = words.withColumn("sep", sep)
    end = F.sum(F.length("sep") + F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))
