"""Shapes of source text: skeletons, digests, anchors, dependencies, relocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNATURE_LINE = r"^\s*(?:pub\s+|export\s+|async\s+|default\s+|abstract\s+)*(?:fn|function|def|func|fun|class|interface|enum|struct|trait|type|const)\s+[A-Za-z_]"


def skeleton(lines: DataFrame) -> DataFrame:
    """The lines that declare something: (path, n, line)."""
    return lines.where(F.col("line").rlike(SIGNATURE_LINE))


def fold(lines: DataFrame, by: str = "path", most: float = 0.8) -> DataFrame:
    """Top-level lines and a mark of what each hides; the skeleton where over
    ``most`` of a file's lines would stay."""
    d = lines.withColumn("top", F.col("line").rlike(r"^\S"))
    w = Window.partitionBy(by)
    share = F.sum(F.col("top").cast("int")).over(w) / F.count("*").over(w)
    d = d.withColumn("share", share)
    run = F.sum(F.col("top").cast("int")).over(w.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("run", run)
    hidden = F.sum((~F.col("top")).cast("int")).over(Window.partitionBy(by, "run"))
    d = d.withColumn("hidden", hidden)
    stay = F.when(F.col("share") > most, F.col("line").rlike(SIGNATURE_LINE)).otherwise(F.col("top"))
    return d.where(stay).select(by, "n", "line", F.when(F.col("share") > most, 0).otherwise(F.col("hidden")).alias("hidden"))


def digest(lines: DataFrame, by: str = "path", most: int = 20) -> DataFrame:
    """The first declarations of each file, one string."""
    r = F.row_number().over(Window.partitionBy(by).orderBy("n"))
    d = skeleton(lines).withColumn("r", r).where(F.col("r") <= most)
    return d.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.trim("line").alias("line")))), lambda x: x["line"]), "; ").alias("digest"))


def anchor(symbols: DataFrame, kind: str, name: str, nth: int = 1) -> DataFrame:
    """``kind(name#n)``: the n-th symbol of that kind and name in each file."""
    r = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    return symbols.where((F.col("kind") == kind) & (F.col("name") == name)).withColumn("r", r).where(F.col("r") == nth).drop("r")


def block_ends(lines: DataFrame, by: str = "path") -> DataFrame:
    """(path, line, end): for each line that opens a block, the line whose brace closes it."""
    change = F.length("line") - F.length(F.replace("line", F.lit("{"))) - (F.length("line") - F.length(F.replace("line", F.lit("}"))))
    w = Window.partitionBy(by).orderBy("n")
    d = lines.withColumn("after", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("after") - change)
    opens = d.where(F.col("line").contains("{") & (F.col("after") > F.col("before"))).select(by, "n", F.col("before").alias("depth"), F.lit(True).alias("open"))
    # a line that closes several blocks reaches each of their depths; the next to reach a block's depth closes it
    closes = d.where(F.col("after") < F.col("before")).select(by, "n", F.explode(F.sequence("after", F.col("before") - 1)).alias("depth"), F.lit(False).alias("open"))
    # from the end, as a frame that ends with the group is added up anew for each row
    ahead = Window.partitionBy(by, "depth").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    found = opens.unionByName(closes).withColumn("end", F.min(F.when(~F.col("open"), F.col("n"))).over(ahead))
    return found.where(F.col("open") & F.col("end").isNotNull()).select(by, F.col("n").alias("line"), "end")


def dependencies(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(path, name, needs): symbols of the same file that a symbol's lines call.

    symbols: (path, name, line, end); calls: (path, line, name)."""
    known = symbols.select("path", F.col("name").alias("needs")).distinct()
    called = calls.select("path", F.col("line").alias("at"), F.col("name").alias("needs")).distinct().join(known, ["path", "needs"], "left_semi")
    inside = called.join(symbols, "path").where((F.col("at") >= F.col("line")) & (F.col("at") <= F.col("end")))
    return inside.where("needs <> name").select("path", "name", "needs").distinct()


def relocate(lines: DataFrame, wanted: DataFrame, by: str = "doc_id", near: int = 10) -> DataFrame:
    """Where a line went: still there, within ``near`` lines, or the only equal line; else null.

    wanted: (by, text, expected)."""
    d = wanted.join(lines, (wanted[by] == lines[by]) & (wanted["text"] == lines["line"]), "left").select(wanted[by], "text", "expected", "n")
    away = F.abs(F.col("n") - F.col("expected"))
    g = d.groupBy(by, "text", "expected").agg(F.count("n").alias("k"), F.min(F.struct(away.alias("away"), F.col("n"))).alias("best"))
    place = F.when(F.col("best.away") <= near, F.col("best.n")).when(F.col("k") == 1, F.col("best.n"))
    how = F.when(F.col("best.away") == 0, "exact").when(F.col("best.away") <= near, "near").when(F.col("k") == 1, "unique").otherwise("lost")
    return g.select(by, "text", "expected", place.alias("n"), how.alias("how"))


def rewrite_imports(line: Column, moved: dict[str, str]) -> Column:
    """Module names in import lines, old to new."""
    out = line
    for old, new in moved.items():
        out = F.when(F.trim(line).rlike(r"^(import|from|use)\b") & out.contains(old), F.replace(out, F.lit(old), F.lit(new))).otherwise(out)
    return out


# fixed values: how statements that import and declarations that export begin
IMPORT_LINE = r"^\s*(?:import|use|require|from|include|#include|using)\b"
EXPORT_LINE = r"^\s*(?:export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var|type|interface|enum)\s+\w+|pub(?:\([^)]*\))?\s+(?:async\s+)?(?:fn|struct|enum|trait|type|const|static|mod)\s+\w+)"


def import_statements(lines: DataFrame, by: str = "path") -> DataFrame:
    """(by, n, line): each import statement at its first line. One that opens a
    brace, or with ``from`` a parenthesis, and doesn't close it goes on to the next
    line that does, trimmed and joined by blanks (to the end if none does)."""
    t = F.btrim("line", F.lit(" \t\r"))
    starts = F.col("line").rlike(IMPORT_LINE)
    brace = t.contains("{") & ~t.contains("}")
    paren = t.startswith("from ") & t.contains("(") & ~t.contains(")")
    ahead = Window.partitionBy(by).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    close = lambda c: F.coalesce(F.min(F.when(F.col("line").contains(c), F.col("n"))).over(ahead), F.max("n").over(ahead), F.col("n"))
    end = F.when(brace, close("}")).when(paren, close(")")).otherwise(F.col("n"))
    d = lines.select(by, "n", "line", F.when(starts, F.struct(F.col("n").alias("first"), end.alias("end"))).alias("own"))
    so_far = Window.partitionBy(by).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    # a line inside a statement doesn't begin another
    reach = F.max("own.end").over(Window.partitionBy(by).orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("own", F.when(F.coalesce(F.col("n") > reach, F.lit(True)), F.col("own")))
    d = d.withColumn("part", F.last("own", ignorenulls=True).over(so_far)).where((F.col("n") >= F.col("part.first")) & (F.col("n") <= F.col("part.end")))
    text = F.array_sort(F.collect_list(F.struct("n", "line")))
    g = d.groupBy(by, F.col("part.first").alias("first")).agg(text.alias("x"))
    joined = F.when(F.size("x") == 1, F.get("x", F.lit(0))["line"]).otherwise(F.array_join(F.transform("x", lambda x: F.btrim(x["line"], F.lit(" \t\r"))), " "))
    return g.select(by, F.col("first").alias("n"), joined.alias("line"))


def export_lines(lines: DataFrame, by: str = "path") -> DataFrame:
    """(by, n, line): the lines that export or publish a declaration, trimmed."""
    return lines.where(F.col("line").rlike(EXPORT_LINE)).select(by, "n", F.btrim("line", F.lit(" \t\r")).alias("line"))


def near(lines: DataFrame, hit: Column, around: int, by: str = "path") -> DataFrame:
    """The lines within ``around`` of one that is hit."""
    w = Window.partitionBy(by).orderBy("n").rangeBetween(-around, around)
    return lines.withColumn("__near", F.max(hit.cast("int")).over(w)).where("__near = 1").drop("__near")


def shaped(lines: DataFrame, shape: str, arg: str | int | None = None, by: str = "path") -> DataFrame:
    """(by, n, line) of lines (by, n, line) in one of SHAPES, of which some take an argument."""
    from ..operators.filters import line_test
    from .text import CONCEPTS, identifiers, in_ranges

    d, line = lines.select(by, "n", "line"), F.col("line")
    whole = Window.partitionBy(by)
    if shape not in SHAPES:
        raise ValueError(f"no shape {shape!r}; there are {', '.join(SHAPES)}")
    if shape == "sig":
        return skeleton(d)
    if shape == "fold":
        return fold(d, by).select(by, "n", "line")
    if shape == "dedent":
        blank = F.trim("line") == ""
        cut = F.coalesce(F.min(F.when(~blank, F.length("line") - F.length(F.ltrim("line")))).over(whole), F.lit(0))
        return d.withColumn("__cut", cut).select(by, "n", F.when(blank, "").otherwise(F.expr("substring(line, __cut + 1)")).alias("line"))
    if shape == "nocomment":
        return d.where(~F.trim("line").rlike(r"^(//|#|/\*|\*)") & (F.trim("line") != ""))
    if shape == "head":
        return d.where(F.col("n") <= int(arg))
    if shape == "tail":
        return d.withColumn("__n", F.max("n").over(whole)).where(F.col("n") > F.col("__n") - int(arg)).drop("__n")
    if shape == "grep":
        return near(d, line.rlike(arg), 1, by)
    if shape == "exclude":
        return d.where(~in_ranges(F.col("n"), arg))
    if shape == "imports":
        return import_statements(d, by)
    if shape == "exports":
        return export_lines(d, by)
    if shape == "concept":
        words = CONCEPTS.get(arg, (arg,)) if isinstance(CONCEPTS, dict) else (arg,)
        hit = F.lit(False)
        for w in dict.fromkeys((arg, *words)):
            hit = hit | F.lower("line").contains(w.lower())
        return near(d, hit, 2, by)
    if shape == "pattern":
        return near(d, F.lower("line").rlike(arg.lower()), 2, by)
    if shape == "if":
        return d.where(line_test(line, arg))
    if shape == "refs":
        names = d.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
        return names.select(by, F.posexplode(identifiers(F.col("text"), list(KEYWORDS))).alias("n", "line")).withColumn("n", F.col("n") + 1)
    return d  # full, snap and highlight show the lines as they are


# fixed values
SHAPES = ("full", "sig", "fold", "dedent", "nocomment", "head", "tail", "grep", "exclude", "imports", "exports", "highlight", "concept", "pattern", "if", "snap", "refs")
KEYWORDS = ("if", "else", "for", "while", "return", "function", "class", "const", "let", "var", "fn", "def", "import", "from", "export", "pub", "use", "struct", "enum", "new", "this", "self", "true", "false", "null")
