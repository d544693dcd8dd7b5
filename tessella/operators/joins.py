"""Joins that answer questions about code: edges, impact, clones, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .intervals import innermost
from .windows import jaccard


def callers_of(symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Symbols that call one of that name."""
    called = symbols.where(F.col("name") == name).select(F.col("id").alias("to_symbol_id"))
    ids = edges.join(called, "to_symbol_id").select(F.col("from_symbol_id").alias("id")).distinct()
    return symbols.join(ids, "id", "left_semi")


def resolve_imports(imports: DataFrame, files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """(from_id, module, to_id): the first candidate path that exists (the
    module itself, then with each extension), or the least path it ends."""
    candidates = F.array(F.col("module"), *[F.concat("module", F.lit(x)) for x in extensions])
    c = imports.select("from_id", "module", F.posexplode(candidates).alias("place", "path"))
    exact = c.join(files.select(F.col("id").alias("to_id"), "path"), "path").groupBy("from_id", "module").agg(F.min_by("to_id", "place").alias("to_id"))
    rest = imports.join(exact, ["from_id", "module"], "left_anti")
    # the base name makes the suffix test an equi-join
    base = lambda p: F.element_at(F.split(p, "/"), -1)
    wanted = rest.select("from_id", "module", F.explode(candidates).alias("tail")).withColumn("base", base("tail"))
    ends = wanted.join(files.select(F.col("id").alias("to_id"), "path", base("path").alias("base")), "base").where(F.col("path").endswith(F.concat(F.lit("/"), F.col("tail"))))
    suffix = ends.groupBy("from_id", "module").agg(F.min_by("to_id", "path").alias("to_id"))
    return exact.unionByName(suffix).where("from_id <> to_id")


def call_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_symbol_id, to_symbol_id): the caller is the scope's symbol in the
    file, or the file's first function by line; the callee is the first symbol
    of the last dotted segment, functions before others."""
    scope = calls.select("id", "file_id", F.element_at(F.split("name", r"\."), -1).alias("callee"), "scope_name")
    own = symbols.groupBy("file_id", F.col("name").alias("scope_name")).agg(F.min("id").alias("own"))
    first = symbols.where(F.col("kind").isin("function", "method")).groupBy("file_id").agg(F.min_by("id", F.struct("line", "id")).alias("first"))
    place = F.when(F.col("kind").isin("function", "method"), 0).otherwise(1)
    callee = symbols.groupBy(F.col("name").alias("callee")).agg(F.min_by("id", F.struct(place, F.col("id"))).alias("to_symbol_id"))
    d = scope.join(own, ["file_id", "scope_name"], "left").join(first, "file_id", "left").join(callee, "callee")
    return d.select(F.coalesce("own", "first").alias("from_symbol_id"), "to_symbol_id").where("from_symbol_id is not null and from_symbol_id <> to_symbol_id").distinct()


def references(calls: DataFrame, relations: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Calls of the name, and the lines of symbols that relate to it, one for each (file, line)."""
    direct = calls.where(F.col("name") == name).select("file_id", "line")
    target = symbols.where(F.col("name") == name).select(F.col("id").alias("to_symbol_id"))
    related = relations.join(target, "to_symbol_id").join(symbols, F.col("from_symbol_id") == F.col("id")).select("file_id", "line")
    return direct.unionByName(related).distinct()


def usage(calls: DataFrame, relations: DataFrame, symbols: DataFrame, name: str, most: int = 500, most_like: int = 50) -> DataFrame:
    """(file_id, line): where a name is used. Calls of it; of the symbols that
    relate to it the calls in their scope, the first ``most``; and where there is
    none of either, symbols of another name whose signature holds it (of three
    characters or more), the first ``most_like``."""
    direct = calls.where(F.col("name") == name).select("file_id", "line").distinct()
    target = symbols.where(F.col("name") == name).select(F.col("id").alias("to_symbol_id"))
    scopes = relations.where("type = 'CALLS'").join(target, "to_symbol_id").join(symbols.select(F.col("id").alias("from_symbol_id"), "file_id", F.col("name").alias("scope_name")), "from_symbol_id").select("file_id", "scope_name").distinct()
    related = calls.join(scopes, ["file_id", "scope_name"]).select("file_id", "line").distinct().orderBy("file_id", "line").limit(most)
    found = direct.unionByName(related).distinct()
    if len(name) < 3 or not found.isEmpty():
        return found
    like = symbols.where(F.lower("signature").contains(name.lower()) & (F.col("name") != name))
    return like.select("file_id", "line").distinct().orderBy("file_id", "line").limit(most_like)


def change_impact(imports: DataFrame, files: DataFrame, targets: list[int]) -> DataFrame:
    """direct importers of the targets, and the importers of those; the risk by their number."""
    t = files.where(F.col("id").isin(*targets)).select("id")
    direct = imports.where(F.col("to_file_id").isin(*targets) & ~F.col("from_file_id").isin(*targets)).select(F.col("from_file_id").alias("id")).distinct()
    second = imports.join(direct.withColumnRenamed("id", "to_file_id"), "to_file_id").select(F.col("from_file_id").alias("id")).distinct().join(direct, "id", "left_anti").join(t, "id", "left_anti")
    both = direct.withColumn("distance", F.lit(1)).unionByName(second.withColumn("distance", F.lit(2)))
    n = F.count("*").over(Window.partitionBy())
    return both.withColumn("risk", F.when(n > 20, "high").when(n > 5, "medium").otherwise("low"))


def clones(symbols: DataFrame, key: Column) -> DataFrame:
    """Pairs of a class's first symbol and each other of the same key: as many
    rows as symbols, from which all pairs follow."""
    d = symbols.select("id", key.alias("key"))
    first = d.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return d.join(first, "key").where("id <> first").select("first", F.col("id").alias("other"), "n")


def signature_tokens(signature: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(signature), r"[^a-z0-9]+"), lambda t: t != ""))


def similar_signatures(symbols: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of symbols whose signatures' token sets reach the Jaccard threshold.

    Symbols of one set are a class, and only classes are compared: candidates
    share a token of a prefix in global order of rarity, as an exact similarity
    join needs, and lengths and places in the order bound the rest. Pairs of
    classes are expanded to those of their members at the end, so that the work
    is that of the different sets and of the rows returned."""
    d = symbols.select("id", F.array_sort(signature_tokens(F.col("signature"))).alias("set")).where(F.size("set") > 0)
    classes = graph.save(d.groupBy("set").agg(F.min("id").alias("class")))
    df = classes.select(F.explode("set").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    ordered = classes.select("class", F.explode("set").alias("t")).join(df, "t").groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda x: x["t"]).alias("tokens"))
    n, n2 = F.size("tokens"), F.size("tokens2")
    prefix = F.slice("tokens", F.lit(1), n - F.ceil(n * threshold - 1e-9).cast("int") + 1)
    p = ordered.select("class", "tokens", F.posexplode(prefix).alias("i", "t"))
    q = p.select(F.col("class").alias("class2"), F.col("tokens").alias("tokens2"), F.col("i").alias("i2"), "t")
    # the tokens behind the shared ones must suffice
    enough = F.least(n - F.col("i"), n2 - F.col("i2")) >= threshold / (1 + threshold) * (n + n2) - 1e-9
    near = p.join(q, "t").where((F.col("class") < F.col("class2")) & (F.least(n, n2) >= threshold * F.greatest(n, n2)) & enough)
    near = near.withColumn("similarity", jaccard(F.col("tokens"), F.col("tokens2"))).where(F.col("similarity") >= threshold).select("class", "class2", "similarity").distinct()
    same = classes.select("class", F.col("class").alias("class2"), F.lit(1.0).alias("similarity"))
    members = graph.save(d.join(classes, "set").select("id", "class"))
    # few bytes that become many rows: so many tasks whatever their size
    asked = members.join(same.unionByName(near), "class").repartition(int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    pairs = asked.join(members.select(F.col("id").alias("id2"), F.col("class").alias("class2")), "class2")
    # a class with itself gives each pair both ways, two classes give it once
    pairs = pairs.where((F.col("class") != F.col("class2")) | (F.col("id") < F.col("id2")))
    return pairs.select(F.least("id", "id2").alias("id"), F.greatest("id", "id2").alias("other"), "similarity")


#: Kinds that count as functions (fixed values), and functions that one search may name.
FUNCTIONS, MOST_NAMED = ("function", "method", "arrow_function", "generator_function"), 1000


def similar_functions(symbols: DataFrame, names: list[str], threshold: float = 0.8, limit: int = 20) -> DataFrame:
    """(source, id, similarity, match_type) of the functions that are like the
    first function of each name (or, if there is none, like the name): the same
    signature but for case and blanks, a similar one, or, where that falls short,
    a similar name at 0.7. ``limit`` of each name, and in all.

    symbols: (id, file_id, name, kind, line, signature). Every different name and
    signature is compared with each of the names, of which there are MOST_NAMED at
    most; of the functions that share both, the first ``limit`` can be found."""
    from ..functions.text import name_similarity, name_words, normal_signature, signature_parts, structural_similarity

    if len(names) > MOST_NAMED:
        raise ValueError(f"{MOST_NAMED} names at most")
    spark = symbols.sparkSession
    functions = symbols.where(F.col("kind").isin(*FUNCTIONS)).select("id", "name", F.coalesce(F.nullif("signature", F.lit("")), "name").alias("text"), normal_signature(F.col("signature")).alias("normal"))
    asked = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "source string")
    own = functions.join(F.broadcast(asked), F.col("name") == F.col("source")).groupBy("source").agg(F.min_by(F.struct("id", "text", "normal"), "id").alias("s"))
    like = F.coalesce("s.text", "source")
    sources = asked.join(own, "source", "left").select("source", F.col("s.id").alias("own"), F.col("s.normal").alias("same"), signature_parts(like).alias("like"), name_words(F.col("source")).alias("words"))
    # one more than can be returned, as a name's own function isn't
    first = Window.partitionBy("name", "text", "normal").orderBy("id")
    kept = graph.save(functions.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= limit + 1))
    # so many tasks whatever the bytes: each row is compared with all names
    values = kept.where("__k = 1").select("name", "text", "normal").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = values.select("*", signature_parts(F.col("text")).alias("__parts"), name_words(F.col("name")).alias("__words")).crossJoin(F.broadcast(sources))  # a row a name
    exact = F.coalesce((F.col("normal") == F.col("same")) & (F.col("same") != ""), F.lit(False))
    d = d.withColumn("__sig", structural_similarity(F.col("like"), F.col("__parts"))).withColumn("__name", name_similarity(F.col("words"), F.col("__words")) * 0.7)
    named = (F.col("__sig") < threshold) & (F.col("__name") > F.col("__sig"))
    d = d.withColumn("similarity", F.when(exact, 1.0).when(named, F.col("__name")).otherwise(F.col("__sig"))).withColumn("match_type", F.when(exact, "body_hash").when(named, "name").otherwise("signature"))
    d = d.where(exact | (F.col("similarity") >= threshold)).select("source", "own", "similarity", "match_type", *[F.col(c).alias(f"__{c}") for c in ("name", "text", "normal")])
    d = kept.join(d, [kept[c].eqNullSafe(d[f"__{c}"]) for c in ("name", "text", "normal")] + [F.col("own").isNull() | (F.col("own") != F.col("id"))])
    # the last bits of equal similarities differ by how they were come by
    near = F.desc(F.round("similarity", 12))
    d = d.withColumn("__r", F.row_number().over(Window.partitionBy("source").orderBy(near, "match_type", "id"))).where(F.col("__r") <= limit)
    return d.orderBy(near, "source", "match_type", "id").limit(limit).select("source", "id", "similarity", "match_type")


#: Lines that a function is cut into for the calls in it to be found.
BLOCK = 64


def intra_file_graph(symbols: DataFrame, calls: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file_id, from_id, to_id): functions and the symbols of their file that
    calls on their lines name, themselves aside.

    Calls count once for each file, name and line. They meet functions by blocks
    of lines, and what names a function calls is told before the symbols of those
    names join, so that the work is that of calls, blocks and results.

    symbols: (id, file_id, name, kind, start, end); calls: (file_id, name, line)."""
    cut = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block)))
    f = symbols.where(F.col("kind").isin("function", "method") & (F.col("start") <= F.col("end"))).select("file_id", F.col("id").alias("from_id"), "start", "end", cut.alias("at"))
    t = symbols.select("file_id", "name", F.col("id").alias("to_id"))
    c = calls.select("file_id", "name", "line").distinct().withColumn("at", F.floor(F.col("line") / block))
    named = c.join(f, ["file_id", "at"]).where("start <= line and line <= end").select("file_id", "from_id", "name").distinct()
    # an id could stand twice
    return named.join(t, ["file_id", "name"]).where("from_id <> to_id").select("file_id", "from_id", "to_id").distinct()


def enclosing(spans: DataFrame, points: DataFrame) -> DataFrame:
    """(point, span): the smallest span of the file that holds the point's line, not its own.

    spans: (file, span, start, end); points: (file, point, line)."""
    s = spans.select("file", "span", "start", "end", F.col("span").cast("string").alias("label"))
    p = points.select("file", "point", "line", F.col("point").cast("string").alias("label"))
    return innermost(s, p, "file").select("point", "span")


def overlap_blocks(blocks: DataFrame, chunks: DataFrame, share: float = 0.8, least: int = 4) -> DataFrame:
    """(block, chunk, containment): of the chunks that hold ``share`` of a
    block's distinct trimmed lines (``least`` at least), the first.

    blocks: (block, line); chunks: (chunk, line). Lines travel as 128 bits of their SHA-256."""
    key = F.substring(F.unhex(F.sha2("line", 256)), 1, 16)
    clean = lambda d, c: d.select(c, F.trim("line").alias("line")).where("line <> ''").select(c, key.alias("line")).distinct()
    b, c = clean(blocks, "block"), clean(chunks, "chunk")
    size = b.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # prefix filter: of a block's lines, a chunk that holds enough of them has one of the rarest
    df = c.groupBy("line").agg(F.count("*").alias("df"))
    rare = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("line"))))
    need = F.greatest(F.ceil(F.col("n") * share - 1e-9), F.lit(least)).cast("int")
    lines = b.join(size, "block").join(df, "line", "left").groupBy("block", "n").agg(rare.alias("x"))
    prefix = lines.select("block", "n", F.explode(F.slice("x", F.lit(1), F.col("n").cast("int") - need + 1)).alias("y")).select("block", "n", "y.line")
    # a chunk of too few lines can't hold enough
    found = c.groupBy("chunk").agg(F.count("*").alias("held")).where(F.col("held") >= least)
    pairs = prefix.join(c, "line").where("block <> chunk").select("block", "chunk", "n").distinct()
    pairs = pairs.join(found, "chunk").where(F.col("held") >= F.greatest(F.ceil(F.col("n") * share - 1e-9), F.lit(least))).drop("held")
    hits = pairs.join(b, "block").join(c, ["chunk", "line"]).groupBy("block", "chunk", "n").agg(F.count("*").alias("k"))
    ok = hits.withColumn("containment", F.col("k") / F.col("n")).where((F.col("containment") >= share) & (F.col("k") >= least) & (F.col("block") != F.col("chunk")))
    return ok.groupBy("block").agg(F.min(F.struct("chunk", "containment")).alias("x")).select("block", "x.chunk", "x.containment")


def forward_chain(forwards: DataFrame, start: DataFrame, hops: int = 16) -> DataFrame:
    """(start, last, hops): where a chain of forwards leads, cycles cut, at most ``hops`` steps.

    forwards: (old, new), one for each old; start: (start)."""
    d = graph.save(start.select("start", F.col("start").alias("last"), F.array("start").alias("seen"), F.lit(0).alias("hops"), F.lit(True).alias("live")))
    for _ in range(hops):
        step = d.join(forwards, F.col("last") == F.col("old"), "left")
        go = F.col("live") & F.col("new").isNotNull() & ~F.coalesce(F.array_contains("seen", F.col("new")), F.lit(False))
        d = graph.save(step.select("start", F.when(go, F.col("new")).otherwise(F.col("last")).alias("last"), F.when(go, F.concat("seen", F.array("new"))).otherwise(F.col("seen")).alias("seen"), (F.col("hops") + go.cast("int")).alias("hops"), go.alias("live")))
        if d.where("live").isEmpty():
            break
    return d.select("start", "last", "hops")


def resolve_short(hashes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, hash): the exact hash, or the only one that starts with the prefix."""
    head = 6
    h = hashes.select("hash", F.substring("hash", 1, head).alias("head")).distinct()
    hit = prefixes.withColumn("head", F.substring("prefix", 1, head)).join(h, "head").where(F.col("hash").startswith(F.col("prefix")))
    g = hit.groupBy("prefix").agg(F.count("*").alias("n"), F.min("hash").alias("one"), F.max(F.when(F.col("hash") == F.col("prefix"), F.col("hash"))).alias("exact"))
    return prefixes.join(g, "prefix", "left").select("prefix", F.coalesce("exact", F.when(F.col("n") == 1, F.col("one"))).alias("hash"))


# What a cached input token costs of an ordinary one.
ANTHROPIC_CACHE_READ, ANTHROPIC_CACHE_WRITE, OPENAI_CACHED, GOOGLE_CACHED = 0.1, 1.25, 0.1, 0.25


def price(usage: DataFrame, prices: list[dict]) -> DataFrame:
    """Usage rows with input_cost, output_cost and total_cost in cents.

    prices: provider, prefix, input, output a million tokens and, if it differs,
    cached_input; the first of the row's provider whose prefix starts the
    model's name, case aside, holds. One provider counts cached tokens beside
    the input, at rates of their own; for the others they are a part of it.
    Rows without a price or with a negative count cost nothing."""
    low, found = F.lower("model"), F.lit(None)
    for p in reversed(prices):
        cached = p.get("cached_input")
        row = F.struct(F.lit(float(p["input"])).alias("input"), F.lit(float(p["output"])).alias("output"), F.lit(None if cached is None else float(cached)).cast("double").alias("cached"))
        found = F.when((F.col("provider") == p["provider"]) & low.startswith(p["prefix"]), row).otherwise(found)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    counts = [n(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")]
    given, written, read, made = [c.cast("double") / 1e6 for c in counts]
    at, who = F.col("__price"), F.col("provider")
    rest = F.greatest(F.lit(0.0), given - read)
    cost = F.when(who == "anthropic", given * at["input"] + read * at["input"] * ANTHROPIC_CACHE_READ + made * at["input"] * ANTHROPIC_CACHE_WRITE)
    cost = cost.when(who == "openai", rest * at["input"] + read * F.coalesce(at["cached"], at["input"] * OPENAI_CACHED))
    cost = cost.when(who.isin("google", "vertex"), rest * at["input"] + read * at["input"] * GOOGLE_CACHED).otherwise(given * at["input"])
    right = F.least(*counts) >= 0
    d = usage.withColumn("__price", found)
    d = d.withColumn("input_cost", F.coalesce(F.when(right, cost), F.lit(0.0))).withColumn("output_cost", F.coalesce(F.when(right, written * at["output"]), F.lit(0.0)))
    return d.withColumn("total_cost", F.col("input_cost") + F.col("output_cost")).drop("__price")


def reconcile_imports(imports: DataFrame, changed: DataFrame) -> DataFrame:
    """imports (file, import_path) with ``broken``: whether a changed path
    without its extension ends in the import, also without extension and a
    leading ``./``, or the other way round.

    Ends meet by equality at slashes (``ending``), so no pair is looked at that
    differs after one."""
    bare = lambda c: F.regexp_replace(c, r"\.[^.]+$", "")
    stems = changed.select(bare(F.col("path")).alias("t")).distinct()
    asked = imports.withColumn("__base", bare(F.regexp_replace("import_path", r"^\./", "")))
    bases = asked.select(F.col("__base").alias("t")).distinct()
    longer, shorter = ending(stems, bases).select(F.col("end").alias("__base")), ending(bases, stems).select(F.col("t").alias("__base"))
    hit = longer.union(shorter).distinct().withColumn("__hit", F.lit(True))
    return asked.join(hit, "__base", "left").select(*imports.columns, F.coalesce("__hit", F.lit(False)).alias("broken"))


def ending(texts: DataFrame, ends: DataFrame) -> DataFrame:
    """(t, end): which of ``ends`` (t) the texts (t) end in.

    An end with a slash meets a text by what follows the first one, and the name
    before it is compared; one without meets the ends of the last names."""
    name, tail = (lambda c, p: F.regexp_extract(c, p, 1)), r"(?s)^[^/]*(/.*)$"
    t, e = F.col("t"), F.col("end")
    slashes = F.filter(F.sequence(F.lit(1), F.length("t")), lambda i: F.substring(t, i, F.lit(1)) == "/")
    cut = texts.select("t", F.explode(slashes).alias("i")).select("t", F.expr("substring(t, i, length(t))").alias("tail"), F.substring_index(F.expr("substring(t, 1, i - 1)"), "/", -1).alias("name"))
    e_rows = ends.select(F.col("t").alias("end")).distinct()
    with_slash = e_rows.where(e.contains("/")).select("end", name(e, tail).alias("tail"), F.substring_index("end", "/", 1).alias("head"))
    first = cut.join(with_slash, "tail").where(F.endswith("name", F.col("head"))).select("t", "end")
    last = F.substring_index("t", "/", -1)
    each = texts.select("t", F.explode(F.transform(F.sequence(F.lit(1), F.length(last) + 1), lambda i: F.substring(last, i, F.length(last)))).alias("end"))
    return first.unionByName(each.join(e_rows.where(~e.contains("/")), "end").select("t", "end")).distinct()


def reconcile_exports(exports: DataFrame, changed: DataFrame) -> DataFrame:
    """exports (file, ..) with ``still_defined``: the file hasn't changed."""
    c = changed.select(F.col("path").alias("file")).distinct().withColumn("__hit", F.lit(True))
    return exports.join(c, "file", "left").select(*exports.columns, F.col("__hit").isNull().alias("still_defined"))


def pair_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each call with its result, a synthetic one where there is none."""
    d = calls.join(results, "call_id", "left")
    return d.withColumn("synthetic", F.col("result").isNull()).withColumn("result", F.coalesce("result", F.lit("[missing]")))


def ready_tasks(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """Pending tasks all of whose dependencies exist and are completed.

    tasks: (task, status); needs: (task, needs)."""
    done = tasks.where("status = 'completed'").select(F.col("task").alias("needs"))
    blocked = needs.join(done, "needs", "left_anti").select("task").distinct()
    return tasks.where("status = 'pending'").join(blocked, "task", "left_anti")


def call_hierarchy(relations: DataFrame, symbols: DataFrame, files: DataFrame, calls: DataFrame, start: DataFrame, depth: int = 3, callers: bool = True, per: int = 20) -> DataFrame:
    """(level, parent, node, confidence): who calls whom, level by level from the
    symbols of ``start`` (node), ``per`` a parent.

    Recorded relations count 1. A symbol without any is looked up by name among
    the calls: its callers are the symbols that such a call's scope names in the
    call's file, its callees those that the calls in its own scope name; 0.7 in
    its own language, else 0.3. Only ``depth`` ends a cycle."""
    known = symbols.select(F.col("id").alias("node"), "name", "file_id").join(files.select(F.col("id").alias("file_id"), "language"), "file_id")
    a, b = ("to_symbol_id", "from_symbol_id") if callers else ("from_symbol_id", "to_symbol_id")
    edges = relations.where("type = 'CALLS'").select(F.col(a).alias("parent"), F.col(b).alias("node")).distinct().join(known.select("node"), "node", "left_semi")
    last = lambda c: F.substring_index(c, ".", -1)
    made = calls.where("scope_name is not null").select(F.col("file_id").alias("at"), F.col("name").alias("callee"), "scope_name").distinct()
    first = Window.partitionBy("parent").orderBy(F.desc("confidence"), "node")
    frontier, out = start.select(F.col("node").alias("parent")).distinct(), None
    for level in range(1, depth + 1):
        own = known.select(F.col("node").alias("parent"), F.col("name").alias("own"), F.col("file_id").alias("home"), F.col("language").alias("tongue"))
        alone = frontier.join(edges, "parent", "left_anti").join(own, "parent")
        if callers:
            hit = alone.join(made, last(F.col("own")) == last(F.col("callee"))).where((F.col("callee") == F.col("own")) | F.col("callee").endswith(F.concat(F.lit("."), "own")))
            hit = hit.join(known, (F.col("file_id") == F.col("at")) & (F.col("name") == F.col("scope_name")))
        else:
            hit = alone.join(made, (F.col("at") == F.col("home")) & (F.col("scope_name") == F.col("own"))).join(known, F.col("name") == last(F.col("callee")))
        named = hit.select("parent", "node", F.when(F.col("language") == F.col("tongue"), 0.7).otherwise(0.3).alias("confidence")).distinct()
        step = frontier.join(edges, "parent").select("parent", "node", F.lit(1.0).alias("confidence")).unionByName(named)
        step = graph.save(step.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per).select(F.lit(level).alias("level"), "parent", "node", "confidence"))
        out = step if out is None else out.unionByName(step)
        frontier = step.select(F.col("node").alias("parent")).distinct()
    return out


def related_files(relations: DataFrame, seeds: DataFrame, depth: int, per: int = 20, deepest: int = 8) -> DataFrame:
    """(seed, node, depth): files that relations lead to, at their least depth,
    following the first ``per`` of each file, ``deepest`` levels at most."""
    e = relations.select("from_file_id", "to_file_id").distinct()
    e = e.withColumn("k", F.row_number().over(Window.partitionBy("from_file_id").orderBy("to_file_id"))).where(F.col("k") <= per)
    return graph.closure(e, "from_file_id", "to_file_id", seeds, min(depth, deepest))
