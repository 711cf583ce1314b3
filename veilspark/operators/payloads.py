"""Payloads as BINARY: search by bytes and by printable text, and headers of web requests.

A payload is read as one character a byte (ISO 8859-1), so that places are counted in bytes and any bytes can be looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packets import domain_pseudonym
from .report import ranked, written
from .spans import let

# What a request or an answer begins with, headers whose value goes, headers that name a host, ports.
STARTS = ("GET ", "POST ", "PUT ", "DELETE ", "HEAD ", "OPTIONS ", "HTTP/")
SECRET_HEADERS = ("cookie", "set-cookie", "authorization", "proxy-authorization", "x-api-key", "x-auth-token", "x-csrf-token")
HOST_HEADERS, FORWARDED = ("host", "referer", "origin"), "x-forwarded-for"
WEB_PORTS = (80, 8080)
GONE, SOME_ADDRESS = "[REDACTED]", "[ANONYMIZED-IP]"


def chars(payload: Column) -> Column:
    """A character for each byte."""
    return F.decode(payload, "ISO-8859-1")


def printable(text: Column) -> Column:
    """Characters that ASCII does not print become full stops."""
    return F.regexp_replace(text, r"[^\x20-\x7e]", ".")


def byte_hits(packets: DataFrame, term: bytes, reach: int = 32, most: int = 100, payload: str = "payload") -> DataFrame:
    """(packet_no, offset, exact, context): the first place of the bytes in each packet, or else of the same text in any case among
    what is printable; `reach` bytes before and from the place on; at most n packets, the first ones (the limit is the feature).

    An empty term is nowhere. Null payloads have no hits.
    """
    plain, wanted = chars(F.col(payload)), term.decode("latin-1")
    text = "".join(c if " " <= c <= "~" else "." for c in wanted).lower()
    bytes_at = F.instr(plain, F.lit(wanted))
    text_at = F.instr(F.lower(printable(plain)), F.lit(text)) if text == wanted.lower() else F.lit(0)
    at = F.when(bytes_at > 0, bytes_at).otherwise(text_at)
    rows = packets.select("packet_no", payload, at.alias("at"), (bytes_at > 0).alias("exact")).where(F.col("at") > 0 if wanted else F.lit(False))
    start = F.greatest(F.col("at") - reach, F.lit(1))
    context = printable(F.substring(chars(F.col(payload)), start, F.col("at") - start + reach))
    return rows.select("packet_no", (F.col("at") - 1).alias("offset"), "exact", context.alias("context")).orderBy("packet_no", "offset", "context").limit(most)


def _host(value: Column) -> Column:
    """The host of a host header or an address, in lower case, without scheme, port and path."""
    return F.lower(F.regexp_replace(F.regexp_extract(value, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1), ":[0-9]*$", ""))


def _told(payload: Column, web: Column) -> Column:
    """The lines of a request with what each is: struct<line, name, kind, host>; null for other payloads.

    The lines between the first one and the first empty one are headers; the body is one piece, so that it is not read line by line.
    """

    def told(line: Column, i: Column) -> Column:
        name = F.substring_index(line, ":", 1)
        return F.struct(line.alias("line"), name.alias("name"), F.when((i > 0) & line.contains(":"), F.lower(name)).alias("key"))

    def kind(x: Column) -> Column:
        of = F.when(x["key"].isin(*SECRET_HEADERS), "secret").when(x["key"].isin(*HOST_HEADERS), "host").when(x["key"] == FORWARDED, "forwarded")
        host = F.when(x["key"].isin(*HOST_HEADERS), _host(F.trim(F.substring(x["line"], F.length(x["name"]) + 2, F.length(x["line"])))))
        return F.struct(x["line"].alias("line"), x["name"].alias("name"), of.alias("kind"), host.alias("host"))

    def parts(z: Column) -> Column:
        lines = F.transform(F.transform(F.split(z["head"], "\r\n", -1), told), kind)
        body = F.substring(z["text"], F.length(z["head"]) + 3, F.length(z["text"]))
        whole = F.struct(body.alias("line"), F.lit("").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("host"))
        return F.when(F.length(z["head"]) < F.length(z["text"]), F.concat(lines, F.array(whole))).otherwise(lines)

    starts = F.rlike(payload, F.lit("^(?:" + "|".join(STARTS) + ")"))
    return F.when(web & starts, let(F.struct(payload.alias("text"), F.substring_index(payload, "\r\n\r\n", 1).alias("head")), parts))


#: Hosts whose names go to the packets as one map; more come back to their packets by shuffle.
FEW_HOSTS = 500


def redacted_headers(packets: DataFrame, payload: str = "payload") -> DataFrame:
    """packets (packet_no, proto, src_port, dst_port, payload as text) with secret header values gone, hosts renamed and forwarded addresses
    covered, and n_headers, how many lines changed.

    Only requests and answers over TCP with a web port on either side are read; their bodies stay. A host has one name in all packets,
    by the order of its first appearance (packet, line), in any case. The names are counted: few go to all packets as one map; many
    leave the lines as rows and come back as a map for each packet, so no packet is read twice for a host. Null payloads stay null.
    """
    web = F.coalesce((F.col("proto") == 6) & (F.col("src_port").isin(*WEB_PORTS) | F.col("dst_port").isin(*WEB_PORTS)), F.lit(False))
    told = packets.withColumn("__lines", _told(F.col(payload), web))
    named = told.select("packet_no", F.posexplode(F.transform("__lines", lambda x: x["host"])).alias("line_no", "host")).where("host <> ''")
    first = named.groupBy("host").agg(F.min(F.struct("packet_no", "line_no")).alias("f")).select("host", "f.*", F.lit(0).alias("all"))
    names = written(ranked(first, "all", ["packet_no", "line_no", "host"]).select("host", domain_pseudonym(F.col("number"), F.col("host")).alias("new")))
    few = names.count() <= FEW_HOSTS
    mine = named.select("packet_no", "host").distinct().join(names, "host").groupBy(F.col("packet_no").alias("__of")).agg(F.map_from_entries(F.collect_list(F.struct("host", "new"))).alias("__names"))

    def line(x: Column) -> Column:
        new = F.when(x["kind"] == "secret", GONE).when(x["kind"] == "forwarded", SOME_ADDRESS).when(x["kind"] == "host", F.coalesce(F.col("__names")[x["host"]], x["host"]))
        return F.when(x["kind"].isNull(), x["line"]).otherwise(F.concat(x["name"], F.lit(": "), new))

    if few:
        done = told.crossJoin(F.broadcast(names.agg(F.map_from_entries(F.collect_list(F.struct("host", "new"))).alias("__names")))).withColumn("__of", F.lit(None))
    else:
        done = told.join(mine, F.col("packet_no") == F.col("__of"), "left")
    text = F.when(F.col("__lines").isNull(), F.col(payload)).otherwise(F.array_join(F.transform("__lines", line), "\r\n"))
    changed = F.coalesce(F.size(F.filter("__lines", lambda x: x["kind"].isNotNull())), F.lit(0))
    return done.withColumn(payload, text).withColumn("n_headers", F.when(changed > 0, changed).otherwise(0).cast("long")).drop("__lines", "__names", "__of")
