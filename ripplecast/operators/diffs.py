"""Unified diffs as rows, and their aggregates; complexity and symbols of source files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C

# Patterns of definitions and imports, by line.
HUNK_SYMBOL = r"^(?:@@ .+ @@\s*)?(?:def |class |function |async function |export (?:default )?(?:function|class) )(.+)$"
#: A line of a hunk, after its line break, that HUNK_SYMBOL may fit once its sign and spaces are off; most lines fail at their first letter.
DEFINITION_LINE = r"\n([+\-] *(?:@@ |def |class |function |async function |export )[^\n]*)"
PYTHON_FUNCTION, PYTHON_CLASS = r"^(?:async\s+)?def\s+(\w+)\s*\(", r"^class\s+(\w+)"
OTHER_FUNCTION, OTHER_CLASS = r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", r"^(?:export\s+)?class\s+(\w+)"


def _sections(diff: Column) -> Column:
    """Each file's part of a diff: from 'diff --git' on, or from a pair of '---' and '+++' lines before a hunk where there is
    no such line. What stands before the first file is left out."""
    pair = r"\n(?=--- [^\n]*\n\+\+\+ [^\n]*\n@@ -)"

    def files(section: Column) -> Column:
        plain = section.endswith("\n") & ~section.endswith("\n\n") & ~section.endswith("\r\n")
        stripped = F.when(plain, F.substr(section, F.lit(1), F.length(section) - 1)).otherwise(F.regexp_replace(section, "\n$", ""))
        parts = F.split(stripped, pair)
        # the first pair of a git section is its own; most have no line like a pair's first after their first hunk, and aren't searched
        git, after = section.startswith("diff --git "), F.substr(section, F.length(_head(section)) + 1)
        whole = F.when((F.size(parts) == 1) | parts[0].contains("\n@@ "), parts).otherwise(F.concat(F.array(F.concat_ws("\n", F.slice(parts, 1, 2))), F.slice(parts, 3, 1 << 30)))
        return F.when(git & ~after.contains("\n--- "), F.array(stripped)).when(git, whole).otherwise(F.filter(parts, lambda x: x.rlike(r"^--- [^\n]*\n\+\+\+ ")))

    return F.flatten(F.transform(F.split(diff, r"(?dm)^(?=diff --git )"), files))


def _head(section: Column) -> Column:
    """What stands before a part's first hunk."""
    return F.substring_index(section, "\n@@ ", 1)


def diff_files(diffs: DataFrame) -> DataFrame:
    """(change_id, file_ord, file, section, hunks): a row a file of diffs (change_id, diff); blank diffs give none.

    section is the file's text, hunks that from its first hunk on; file: path, change_type, old_path, added, deleted. Only the head of a part and its first hunk's header are searched; lines are counted in its text. Nothing is shuffled.
    """
    rows = diffs.select("change_id", F.posexplode(_sections(F.col("diff"))).alias("at", "section"))
    return _files(rows.select("change_id", (F.col("at") + 1).alias("file_ord"), "section"))


def _files(rows: DataFrame) -> DataFrame:
    """rows (file_ord, section ...) with file and hunks."""
    kept = rows.columns
    rows = rows.withColumn("head", _head(F.col("section")))
    rows = rows.withColumn("hunks", F.substr("section", F.length("head") + 1))  # from the line break before the first hunk on
    header = F.substring_index(F.substr("hunks", F.lit(2)), "\n", 1)
    said = lambda pattern: F.regexp_extract("head", rf"(?dm){pattern}", 1)
    rows = rows.withColumns({"header": header, "minus": said(r"^--- ([^\t\n]+)"), "plus": said(r"^\+\+\+ ([^\t\n]+)")})
    null, has = F.lit("/dev/null"), lambda x: F.nullif(x, F.lit(""))
    source = F.when(F.col("minus") != "", F.col("minus")).when(F.col("head").rlike(r"(?dm)^new file mode "), null).otherwise(has(said(r"^diff --git (a/.*) b/")))
    target = F.when(F.col("plus") != "", F.col("plus")).when(F.col("head").rlike(r"(?dm)^deleted file mode "), null).otherwise(has(said(r"^diff --git a/.* (b/.*)$")))
    rows = rows.withColumns({"source": source, "target": target})
    count = lambda mark: ((F.octet_length("hunks") - F.octet_length(F.replace("hunks", F.lit(mark), F.lit("")))) / len(mark)).cast("long")
    alone = ~F.substr("hunks", F.lit(2)).contains("\n@@ ")
    deleted = (F.col("target") == null) | (F.col("header").rlike(r"^@@ -\S+ \+0,0 @@") & alone)
    added = (F.col("source") == null) | (F.col("header").startswith("@@ -0,0 ") & alone)
    rows = rows.withColumns({"old": F.regexp_replace("source", "^a/", ""), "new": F.regexp_replace("target", "^b/", ""), "gone": deleted, "fresh": added})
    kind = F.when(F.col("gone"), "deleted").when(F.col("fresh"), "added").when(F.col("old") != F.col("new"), "renamed").otherwise("modified")
    rows = rows.withColumn("kind", kind)
    file = F.struct(
        F.when(F.col("gone") & (F.col("source") != null), F.col("old")).otherwise(F.col("new")).alias("path"), F.col("kind").alias("change_type"), F.when(F.col("kind") == "renamed", F.col("old")).alias("old_path"),
        count("\n+").alias("added"), count("\n-").alias("deleted"),
    )
    return rows.select(*[c for c in kept if c != "section"], file.alias("file"), "section", "hunks")


def _short(hunk: Column) -> Column:
    """Whether a hunk has fewer lines of either side than its header says, or a header that says nothing."""
    header = r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@"
    head = F.substring_index(hunk, "\n", 1)
    said = lambda k: F.coalesce(F.nullif(F.regexp_extract(head, header, k), F.lit("")).cast("int"), F.lit(1))
    count = lambda mark: ((F.octet_length(hunk) - F.octet_length(F.replace(hunk, F.lit("\n" + mark), F.lit("")))) / 2).cast("int")
    # marked lines alone are most often enough; empty ones, and those of context, are looked for where they are not
    fewer = lambda mark, n: (count(mark) < n) & (F.regexp_count(hunk, F.lit(rf"\n(?![^\n \{mark}])")) < n)
    return ~head.rlike(header) | fewer("-", said(1)) | fewer("+", said(2))


def broken_hunks(diff: Column) -> Column:
    """Whether a hunk of a diff has fewer lines of either side than its header says, or a header that says nothing."""
    return F.exists(F.flatten(F.transform(_sections(diff), lambda x: F.slice(F.split(x, r"\n(?=@@ )"), 2, 1 << 30))), _short)


def parsed_changes(changes: DataFrame) -> DataFrame:
    """One row a change of changes (change_id, diff ...; one row each), blank diffs too: its other columns, and what ``change_summary`` (changed_files, added, deleted,
    renamed_files), ``modified_symbols`` (symbols, in order) and ``broken_hunks`` say of it; broken is also a diff with hunks but no file.

    A diff is made and cut once. Its files become rows of names and numbers, which meet in one aggregate; the text is not shuffled.
    """
    other = [c for c in changes.columns if c not in ("change_id", "diff")]
    rows = changes.withColumn("sections", _sections(F.col("diff")))
    lost = F.coalesce(F.size("sections"), F.lit(0)) <= 0
    rows = rows.select("change_id", F.struct(*other, F.when(lost, F.coalesce(F.col("diff").rlike(r"(?m)^@@ "), F.lit(False))).alias("__lost")).alias("own"), F.posexplode_outer("sections").alias("at", "section"))
    rows = _files(rows.select("change_id", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("own")).alias("own"), (F.col("at") + 1).alias("file_ord"), "section"))
    names = F.transform(_symbol_names(F.col("hunks")), lambda n: F.concat("file.path", F.lit("::"), n))
    body = F.substr("hunks", F.lit(2))
    short = (F.col("hunks") != "") & F.exists(F.when(body.contains("\n@@ "), F.split(body, r"\n(?=@@ )")).otherwise(F.array(body)), _short)
    one = F.when(F.col("file_ord").isNotNull(), F.struct("file_ord", "file.path", "file.old_path", names.alias("names")))
    rows = rows.select("change_id", "own", one.alias("one"), "file.added", "file.deleted", short.alias("short"))
    found = rows.groupBy("change_id").agg(  # one list, since each list copies its rows
        F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list("one")).alias("files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.coalesce(F.bool_or("short"), F.lit(False)).alias("short"),
    )
    moved = F.transform(F.filter("files", lambda x: x["old_path"].isNotNull()), lambda x: F.struct(x["old_path"].alias("old_path"), x["path"].alias("path")))
    found = found.withColumns({
        "changed_files": F.col("files.path"), "symbols": F.array_distinct(F.flatten("files.names")),
        "renamed_files": F.map_from_entries(_first_of_each(F.array_sort(F.array_distinct(moved)))),
    })
    return found.select("change_id", *[F.col("own")[c].alias(c) for c in other], "changed_files", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("deleted", F.lit(0)).alias("deleted"), "renamed_files", "symbols", (F.col("short") | F.coalesce("own.__lost", F.lit(False))).alias("broken"))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """A1: (change_id, line_no, file_ord, hunk_ord, kind, text, file) of diffs (change_id, diff); blank diffs give no rows.

    line_no rises along a change; lines before the first hunk of a file have hunk_ord 0. A diff is cut into files, hunks and
    lines inside its row, so nothing is shuffled; ``file`` tells of the file as ``file_changes`` does.
    """
    rows = diff_files(diffs).select("change_id", "file_ord", "file", F.posexplode(F.split("section", r"\n(?=@@ )")).alias("hunk_ord", "part"))
    rows = rows.select("change_id", "file_ord", "hunk_ord", "file", F.posexplode(F.split("part", "\n")).alias("place", "text"))
    line_no = F.shiftleft(F.col("file_ord").cast("long"), 43) + F.shiftleft(F.col("hunk_ord").cast("long"), 23) + F.col("place")
    kind = F.when(F.col("hunk_ord") == 0, "hdr").when(F.col("place") == 0, "hunk").when(F.col("text").startswith("+"), "add").when(F.col("text").startswith("-"), "del").otherwise("ctx")
    return rows.select("change_id", line_no.alias("line_no"), "file_ord", "hunk_ord", kind.alias("kind"), "text", "file")


def marked_lines(files: DataFrame) -> DataFrame:
    """A1, a row a file of ``diff_files``: (change_id, file_ord, n_add, n_del, n_hdr, lines); lines is the file's text, each line with its kind and a space before it.

    It says what ``diff_lines`` says, without a row a line: kinds are put in by replacing line breaks together with what follows them.
    """
    breaks = lambda text, mark: ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("long")
    rows = files.withColumn("head", _head(F.col("section"))).withColumns({"hunk_lines": breaks("hunks", "\n@@ "), "all_lines": breaks("hunks", "\n")})
    plain = F.col("all_lines") == F.col("hunk_lines") + F.col("file.added") + F.col("file.deleted")
    body = F.when(plain, F.col("hunks")).otherwise(F.regexp_replace("hunks", r"\n(?!@@ |\+|-)", "\nctx "))  # context first, as it may look like a kind
    for mark, kind in (("@@ ", "hunk"), ("+", "add"), ("-", "del")):
        body = F.replace(body, F.lit(f"\n{mark}"), F.lit(f"\n{kind} {mark}"))
    head = F.concat(F.lit("hdr "), F.replace("head", F.lit("\n"), F.lit("\nhdr ")))
    return rows.select("change_id", "file_ord", F.col("file.added").alias("n_add"), F.col("file.deleted").alias("n_del"), (breaks("head", "\n") + 1).alias("n_hdr"), F.concat(head, body).alias("lines"))


def file_changes(rows: DataFrame) -> DataFrame:
    """A2: one row a file: path, change_type, added, deleted, language, old_path; from ``diff_files``, or the first line of each of ``diff_lines``, without a shuffle.

    Without '---' and '+++' lines (a pure rename, an empty or binary file) the 'diff --git' line and the file modes tell.
    """
    if "line_no" in rows.columns:
        rows = rows.where(F.col("line_no") == F.shiftleft(F.col("file_ord").cast("long"), 43))
    return rows.select("change_id", "file_ord", "file.path", "file.change_type", "file.added", "file.deleted", "file.old_path").withColumn("language", C.language(F.col("path")))


def _first_of_each(pairs: Column) -> Column:
    """Of sorted (old_path, path) the first of each old path: a file may be moved and copied at once."""
    return F.filter(pairs, lambda x, i: (i == 0) | (x["old_path"] != F.get(pairs, i - 1)["old_path"]))


def _renamed() -> Column:
    return F.map_from_entries(_first_of_each(F.array_sort(F.collect_set(F.when(F.col("change_type") == "renamed", F.struct("old_path", "path"))))))


def change_summary(files: DataFrame) -> DataFrame:
    """One row a change: files in order, totals, renames, share of deletions."""
    total = F.sum("added") + F.sum("deleted")
    return files.groupBy("change_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "path"))), lambda x: x["path"]).alias("changed_files"),
        F.sum("added").alias("added"), F.sum("deleted").alias("deleted"),
        _renamed().alias("renamed_files"),
        F.when(total > 0, F.sum("deleted") / total).otherwise(0.0).alias("deleted_ratio"),
    )


def _symbol_name(text: Column) -> Column:
    """What a marked line defines, or ''."""
    return F.trim(F.split(F.regexp_extract(F.trim(F.substring(text, 2, 1 << 20)), HUNK_SYMBOL, 1), r"\(")[0])


def _symbol_names(hunks: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(hunks, F.lit(DEFINITION_LINE), F.lit(1)), _symbol_name), lambda n: n != "")


def modified_symbols(rows: DataFrame) -> DataFrame:
    """A4: (change_id, symbol): path::name of definitions on added or removed lines, in order of first sight (``place``).

    rows: ``diff_files``, of whose text only lines that begin a definition become rows, or ``diff_lines``.
    """
    if "hunks" in rows.columns:
        found = rows.select("change_id", "file_ord", F.col("file.path").alias("path"), F.posexplode(_symbol_names(F.col("hunks"))).alias("at", "name"))
        named = found.select("change_id", (F.shiftleft(F.col("file_ord").cast("long"), 43) + F.col("at")).alias("line_no"), "path", "name")
    else:
        lines = rows.where(F.col("kind").isin("add", "del"))
        named = lines.select("change_id", "line_no", F.col("file.path").alias("path"), _symbol_name(F.col("text")).alias("name")).where("name != ''")
    first = named.groupBy("change_id", F.concat("path", F.lit("::"), "name").alias("symbol")).agg(F.min("line_no").alias("line_no"))
    return first.select("change_id", "symbol", F.row_number().over(W.partitionBy("change_id").orderBy("line_no")).alias("place"))


def light_stats(diffs: DataFrame) -> DataFrame:
    """A5: counts straight from the lines; files that are deleted don't count."""
    lines = F.split("diff", "\n")
    count = lambda test: F.size(F.filter(lines, test)).cast("long")
    out = diffs.select(
        "change_id", count(lambda x: x.startswith("+++ b/")).alias("n_files"),
        count(lambda x: x.startswith("+") & ~x.startswith("+++")).alias("added"), count(lambda x: x.startswith("-") & ~x.startswith("---")).alias("deleted"),
    )
    return out.withColumn("deleted_ratio", F.col("deleted") / F.greatest(F.col("added") + F.col("deleted"), F.lit(1)))


def synthetic_diff(requests: DataFrame) -> DataFrame:
    """A diff that adds a request's text as a file; needs repo, number, title, body."""
    path = F.concat(F.lit("webhook/"), F.replace("repo", F.lit("/"), F.lit("_")), F.lit("/pr-"), F.coalesce("number", F.lit(0)).cast("string"), F.lit(".md"))
    body = F.coalesce(F.when(F.col("body") != "", F.col("body")), F.when(F.col("title") != "", F.col("title")), F.lit("Webhook triggered change"))
    lines = F.split(F.regexp_replace(F.substring(body, 1, 2000), "\n$", ""), "\n")
    text = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x)), "\n"), F.lit("\n"))
    return requests.withColumn("diff", text)


def complexity_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, before, after, delta) over the files of either side, (path, content) each."""
    a = before.select("path", C.complexity(F.col("content")).alias("before"))
    b = after.select("path", C.complexity(F.col("content")).alias("after"))
    delta = F.coalesce(F.col("after"), F.lit(0.0)) - F.coalesce(F.col("before"), F.lit(0.0))
    return a.join(b, "path", "full").select("path", "before", "after", delta.alias("delta"))


def source_lines(sources: DataFrame, keys: Sequence[str] = (), holding: Sequence[str] = ()) -> DataFrame:
    """(path, language, line_no from 1, text trimmed) of files (path, content), with ``keys``, columns that tell repositories apart.

    ``holding``: words without white space; only lines that hold one of them are given, and trimmed.
    """
    rows = sources.select(*keys, "path", C.language(F.col("path")).alias("language"), F.posexplode(F.split("content", "\n")).alias("at", "line"))
    if holding:
        rows = rows.where(C.holds_any(F.col("line"), holding))
    return rows.select(*keys, "path", "language", (F.col("at") + 1).alias("line_no"), F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")).alias("text"))


def symbols(sources: DataFrame) -> DataFrame:
    """(path, kind, name, line_no): functions, classes and import lines."""
    return symbols_of(source_lines(sources))


def symbols_of(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    python = F.col("language") == "python"
    found = lambda a, b: F.when(python, F.regexp_extract("text", a, 1)).otherwise(F.regexp_extract("text", b, 1))
    imports = F.when(F.col("text").startswith("import ") | (python & F.col("text").startswith("from ")), F.col("text")).otherwise("")
    kinds = F.array(
        F.struct(F.lit("function").alias("kind"), found(PYTHON_FUNCTION, OTHER_FUNCTION).alias("name")),
        F.struct(F.lit("class").alias("kind"), found(PYTHON_CLASS, OTHER_CLASS).alias("name")),
        F.struct(F.lit("import").alias("kind"), imports.alias("name")),
    )
    return rows.select(*keys, "path", "line_no", F.inline(F.filter(kinds, lambda x: x["name"] != "")))


def function_complexity(sources: DataFrame) -> DataFrame:
    """A10: a file's complexity, shared evenly among its functions."""
    own = symbols(sources).where("kind = 'function'").groupBy("path").agg(F.count("*").alias("n"))
    return sources.select("path", C.complexity(F.col("content")).alias("total")).join(own, "path", "left").select("path", (F.col("total") / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("per_function"))


def symbol_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind, change, name): added, removed and modified symbols; a function is modified if it moved, a class if both hold it."""
    side = lambda s: symbols(s).groupBy("path", "kind", "name").agg(F.max("line_no").alias("line_no"))
    a, b = side(before).withColumnRenamed("line_no", "was"), side(after).withColumnRenamed("line_no", "now")
    both = a.join(b, ["path", "kind", "name"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when((F.col("kind") == "class") | ((F.col("kind") == "function") & (F.col("was") != F.col("now"))), "modified")
    return both.select("path", "kind", "name", change.alias("change")).where("change is not null")


def enrich(files: DataFrame, deltas: DataFrame, changed: DataFrame) -> DataFrame:
    """Per change the summed complexity delta, changed imports and languages, both distinct and sorted."""
    per_file = changed.where("kind = 'import' and change in ('added', 'removed')").groupBy("path").agg(F.collect_set("name").alias("imports"))
    rows = files.join(deltas.select("path", "delta"), "path", "left").join(per_file, "path", "left")
    return rows.groupBy("change_id").agg(
        F.sum(F.coalesce("delta", F.lit(0.0))).alias("complexity_delta"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("imports", F.array().cast("array<string>")))))).alias("dependency_changes"),
        F.array_sort(F.collect_set("language")).alias("languages"),
    )
