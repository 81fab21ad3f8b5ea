"""Line dedup by a log-template tree, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialise

WILD = "<*>"


def line_rows(docs: DataFrame, id_col: str, text_col: str, lead: int) -> DataFrame:
    """(doc_id, line_no, masked, leaf, exact) of every line that isn't blank.

    Lines lose spaces, tabs and carriage returns at their ends; tokens lie between single spaces. A token with a
    digit is a variable field and becomes a wildcard. The leaf of the tree is the number of tokens and the
    ``lead`` first of them; exact is a hash of all.
    """
    line = F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line")
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), line)
    rows = rows.select("doc_id", "line_no", F.btrim("line", F.lit(" \t\r")).alias("plain")).where("plain != ''")
    masked = F.regexp_replace("plain", r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", WILD)
    # a line of variable fields alone has no template to share
    masked = F.when(~F.col("plain").rlike("[0-9]") | (F.regexp_replace(masked, r"<\*>| ", "") == ""), F.col("plain")).otherwise(masked)
    rows = rows.select("doc_id", "line_no", masked.alias("masked"))
    spaces = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit("")))
    return rows.select("doc_id", "line_no", "masked", F.xxhash64(spaces, F.substring_index("masked", " ", lead)).alias("leaf"), F.xxhash64("masked").alias("exact"))


def templates(lines: DataFrame, hashed: DataFrame, similarity: float, small: int = 2_000_000) -> DataFrame:
    """(leaf, exact, template) of the distinct lines of a leaf that holds several; hashed: lines without their text.

    A leaf's centre has at each place the token that most of its lines have (ties to the smaller). Lines
    that agree with it in at least ``similarity`` of their places share its template, in which
    the other places are variable. Of the other lines those that link among themselves share one, by ``others``, and
    each of the rest is a template of its own. The text is gathered for crowded leaves only, which are broadcast
    up to ``small`` of them.
    """
    crowded = hashed.groupBy("leaf").agg(F.min("exact").alias("a"), F.max("exact").alias("z")).where("a != z").select("leaf")
    crowded = materialise(crowded, "lines-crowded")
    crowded = F.broadcast(crowded) if crowded.count() <= small else crowded
    distinct = lines.join(crowded, "leaf", "left_semi").groupBy("leaf", "exact").agg(F.count("*").alias("n"), F.min("masked").alias("masked"))
    distinct = materialise(distinct, "lines-distinct")
    place = F.posexplode(F.split("masked", " ")).alias("place", "token")
    votes = distinct.select("leaf", "n", place).groupBy("leaf", "place", "token").agg(F.sum("n").alias("votes"))
    winner = votes.groupBy("leaf", "place").agg(F.min(F.struct((-F.col("votes")).alias("votes"), "token")).alias("w"))
    centre = winner.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("place", F.col("w.token").alias("token")))).alias("centre"))
    tokens = F.split("masked", " ")
    agrees = _same(tokens, F.col("centre.token")) >= similarity * F.size(tokens)
    placed = materialise(distinct.join(centre, "leaf").select("leaf", "exact", "masked", agrees.alias("agrees")), "lines-centred")
    more = others(placed.where("not agrees").select("leaf", "exact", tokens.alias("tokens")), similarity)
    named = F.when(F.col("agrees"), F.xxhash64("leaf", F.lit("centre"))).when(F.col("root").isNotNull(), F.xxhash64("leaf", F.lit("group"), "root")).otherwise(F.col("exact"))
    return placed.join(more, placed["exact"] == more["node"], "left").select("leaf", "exact", named.alias("template"))


def _same(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _linked(lines: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose lines agree in enough of their places."""
    one, two = (lines.select(F.col("exact").alias(c), F.col("tokens").alias(t)) for c, t in ("ua", "vb"))
    return pairs.distinct().join(one, "u").join(two, "v").where(_same(F.col("a"), F.col("b")) >= similarity * F.size("a")).select("u", "v")


def others(lines: DataFrame, similarity: float, small: int = 32) -> DataFrame:
    """(node, root) of the lines (leaf, exact, tokens) that link to another of their leaf: node is exact, root the
    least of its group. Lines link where they agree in at least ``similarity`` of their places.

    Two such lines differ in at most m places, so of m + 1 sets of places they agree in one. Lines fall into buckets, at first their leaf. In a
    bucket of at most ``small`` lines all pairs are compared. The lines of a larger one are compared with its least; unless that
    puts all of them into one group, the places in which they do not all agree, the most diverse first, are dealt into m + 1 sets, and lines that
    agree in a set are a bucket of the next round. Places that all agree in say nothing and are left out, so buckets shrink, and a bucket in which no
    more than m places are left links to its least as a whole. A pair is compared only in a small bucket or with a least line.
    """
    lines = materialise(lines.withColumn("runs", (F.size("tokens") - F.ceil(F.lit(similarity) * F.size("tokens")) + 1).cast("int")).where("runs > 1"), "lines-others")
    rows, links = lines.select(F.col("leaf").alias("bucket"), "exact"), []
    while True:
        sizes = rows.groupBy("bucket").agg(F.min("exact").alias("least"), F.count("*").alias("size")).where("size > 1")
        rows = materialise(rows.join(sizes, "bucket"), "lines-buckets")
        few = rows.where(F.col("size") <= small).select("bucket", F.col("exact").alias("u"))
        pairs = few.join(few.withColumnRenamed("u", "v"), "bucket").where("u < v").select("u", "v")
        large = rows.where(F.col("size") > small)
        links.append(materialise(_linked(lines, pairs.unionByName(large.where("exact != least").select(F.col("least").alias("u"), F.col("exact").alias("v"))), similarity), "lines-links"))
        groups = components(reduce(DataFrame.unionByName, links), "lines-groups")
        label = large.join(groups, large["exact"] == groups["node"], "left").select("bucket", F.coalesce("root", "exact").alias("label"))
        several = label.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a != z").select("bucket")
        still = materialise(large.join(several, "bucket", "left_semi").select("bucket", "exact").join(lines.drop("leaf"), "exact"), "lines-still")
        if still.isEmpty():
            return groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
        place = still.select("bucket", F.posexplode("tokens").alias("place", "token")).groupBy("bucket", "place")
        free = place.agg((F.min("token") != F.max("token")).alias("free"), F.approx_count_distinct("token").alias("kinds")).where("free")
        free = free.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("kinds")).alias("kinds"), "place"))), lambda x: x["place"]).alias("free"))
        dealt = still.join(free, "bucket").where(F.size("free") >= F.col("runs")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)))
        own = F.transform(F.filter("free", lambda x, i: i % F.col("runs") == F.col("k")), lambda x: F.get("tokens", x))
        rows = dealt.select(F.xxhash64("bucket", "k", own).alias("bucket"), "exact")


def recurring_lines(docs: DataFrame, min_docs: int = 3, lead: int = 3, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no) of the lines to drop: of each template that occurs in at least min_docs
    documents, every line but the first (least doc_id, then line)."""
    lines = line_rows(docs, id_col, text_col, lead)
    hashed = materialise(lines.drop("masked"), "lines-hashed")
    found = materialise(templates(lines, hashed, similarity).where("template != exact"), "lines-templates")
    placed = hashed.join(found, ["leaf", "exact"], "left").select("doc_id", "line_no", F.coalesce("template", "exact").alias("template"))
    per_doc = placed.groupBy("template", "doc_id").agg(F.min("line_no").alias("line_no"))
    common = per_doc.groupBy("template").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "line_no")).alias("first")).where(F.col("docs") >= min_docs)
    later = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("line_no") != F.col("first.line_no"))
    return placed.join(materialise(common, "lines-common").hint("merge"), "template").where(later).select("doc_id", "line_no")


def _without(text: Column, dropped: Column) -> Column:
    """The lines of text whose number isn't in the sorted array ``dropped``.

    Lines are numbered, the dropped numbers joined on as a map's keys, so that the cost follows the number of
    lines and not its square.
    """
    gone = F.map_from_entries(F.transform(dropped, lambda n: F.struct(n, F.lit(True))))
    return F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.coalesce(F.element_at(gone, i), F.lit(False))), "\n")


def drop_recurring_lines(docs: DataFrame, min_docs: int = 3, lead: int = 3, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with recurring template lines removed from ``text_col``; every row and column stays.

    Lines are parsed by a tree of fixed depth: number of tokens, then the ``lead`` first
    tokens, with digit-bearing tokens as wildcards; lines of a leaf that agree in
    ``similarity`` of their places form one template, of which a leaf may hold several. Of a template found in min_docs or more documents
    the first line stays and all others go, so no content is lost altogether. Blank lines
    always stay.

    Null texts stay null, empty ones empty; rows with a null id stay unchanged and aren't counted.
    Repeated rows are one document and are changed alike; different texts of one id count as one document,
    from each of which the lines found in any of them by number are dropped. Further columns of any name are
    carried along. An empty table gives no rows.
    """
    names = docs.columns
    safe = docs.toDF(*[f"c{k}" for k in range(len(names))])
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    dropped = recurring_lines(safe, min_docs, lead, similarity, key, text)
    gone = materialise(dropped.distinct().groupBy("doc_id").agg(F.collect_list("line_no").alias("__gone")), "lines-dropped")
    joined = safe.join(gone.hint("merge"), safe[key].cast("long") == gone["doc_id"], "left")  # grows with docs: never broadcast
    changed = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(_without(F.col(text), F.col("__gone")))
    return joined.select(*[changed.alias(c) if c == text else F.col(c) for c in safe.columns]).toDF(*names)
