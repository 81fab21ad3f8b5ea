"""Web captures: not-modified revisits resolved against the response they confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Headers of a 304 that say nothing about the stored response.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")

_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)(\?[^#]*)?"


def canonical_url(url: Column) -> Column:
    """Host without www. or a default port, in lower case; path without trailing slashes; sorted query without utm_ fields. Null stays null."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 2), "/+$", "")
    fields = F.filter(F.split(F.regexp_replace(F.regexp_extract(url, _URL, 3), r"^\?", ""), "&"), lambda x: (x != "") & ~x.startswith("utm_"))
    query = F.array_join(F.array_sort(fields), "&")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, those of the revisit put in their place where a 304 may update them. Names in lower case."""
    allowed = F.map_filter(F.coalesce(fresh, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*NOT_MERGED))
    kept = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def _opaque(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, carry: tuple[str, ...] = ("payload",), bins: int = 4096) -> DataFrame:
    """One row a revisit: (record_id, canonical_url, ts, matched_id, outcome, headers, *carry).

    records: record_id long, url, ts timestamp, kind ('response' or 'revisit'), status int, headers map of
    lower-case names, and the columns named in carry, which the match hands over. A full
    response is a 'response' of status 200. The match is the latest full response of the same
    canonical URL before the revisit (of equal times the larger record_id; equal to the
    revisit's own time is not before). Validators: where both have an etag these must agree
    (weakly); else, where both have last-modified, these must; else nothing confirms the match.
    outcome: resolved, mismatch, unconfirmed or missing; only resolved rows carry anything on.

    The as-of join is two windows: inside a time bin of a URL, and over the last response of
    each of its bins, of which there are at most ``bins``; so a URL with a large share of all rows is
    spread over its bins. Rows without url, ts or id match nothing and, if revisits, are missing. Repeated
    revisits are each answered; of several responses of one id the latest is carried on (of equal times the one of the greatest
    headers as text). An empty table gives no rows. Further columns are not read.
    """
    own = [f"carry{k}" for k in range(len(carry))]
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", F.col("kind"), F.coalesce("status", F.lit(0)).alias("status"), "headers", *[F.col(c).alias(o) for c, o in zip(carry, own, strict=True)])
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.min(micros), F.max(micros)).first()
    width = max(1, ((high or 0) - (low or 0)) // bins + 1)
    meta = rows.where(usable & (full | (F.col("kind") == "revisit"))).select(
        "record_id", "canonical_url", micros.alias("at"), "kind", ((micros - F.lit(low or 0)) / width).cast("int").alias("bin"), F.when(full, F.struct(micros.alias("at"), "record_id")).alias("mark")
    )
    meta = materialise(meta, "warc-marks")  # ids and times only
    last = meta.groupBy("canonical_url", "bin").agg(F.max("mark").alias("mark"))
    before = F.last("mark", ignorenulls=True).over(W.partitionBy("canonical_url").orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
    carried = last.withColumn("carried", before).select("canonical_url", "bin", "carried")
    earlier = F.max("mark").over(W.partitionBy("canonical_url", "bin").orderBy("at").rangeBetween(W.unboundedPreceding, -1))
    inside = meta.withColumn("inside", earlier).where("kind = 'revisit'").drop("mark")
    matched = inside.join(carried, ["canonical_url", "bin"]).select("record_id", "at", F.coalesce("inside", "carried")["record_id"].alias("matched_id")).distinct()
    said = F.to_json(F.array_sort(F.map_entries("headers")))
    kept = F.struct(F.col("headers").alias("stored"), *own)
    responses = rows.where(usable & full).groupBy("record_id").agg(F.max_by(kept, F.struct(micros, said)).alias("kept")).select(F.col("record_id").alias("key"), F.lit(True).alias("known"), "kept.*")
    revisits = rows.where("kind = 'revisit'").drop(*own).withColumn("at", micros)
    # rows without a match are dealt by their own id and meet nothing
    both = revisits.join(matched, ["record_id", "at"], "left").withColumn("key", F.coalesce("matched_id", F.xxhash64("record_id", "at"))).withColumn("known", F.col("matched_id").isNotNull())
    both = both.join(responses, ["key", "known"], "left").drop("key", "known")
    etag, kept_etag = _opaque(F.col("headers")["etag"]), _opaque(F.col("stored")["etag"])
    date, kept_date = F.col("headers")["last-modified"], F.col("stored")["last-modified"]
    agree = F.when(etag.isNotNull() & kept_etag.isNotNull(), etag == kept_etag).when(date.isNotNull() & kept_date.isNotNull(), date == kept_date)
    outcome = F.when(F.col("matched_id").isNull(), "missing").when(agree.isNull(), "unconfirmed").when(agree, "resolved").otherwise("mismatch")
    done = both.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return done.select(
        "record_id",
        "canonical_url",
        "ts",
        "matched_id",
        "outcome",
        F.when(resolved, merge_headers(F.col("stored"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        *[F.when(resolved, F.col(o)).alias(c) for c, o in zip(carry, own, strict=True)],
    )
