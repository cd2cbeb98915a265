"""Decision quality over many repositories at once: requests ranked against their own repository's modules in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_tokens
from ..session import scratch_path
from . import catalog

# What counts as a provider's type, and the thresholds of a sweep.
PROVIDER_TYPE = r"^aws_[a-z0-9_]+$"
MIN_LENIENT, MAX_FALSE_REUSE = 0.85, 0.05
#: Fixed value: up to so many words a request needs half of them covered.
SHORT = 5
#: Into so many shares a repository's postings of a word are dealt; a request's few probes go to each.
SHARES = 16
#: Ranges of a hash by which types are numbered.
RANGES = 64

#: A repository of up to so many modules is ranked whole, as one array; of a larger one only what shares rare words.
FEW = 64
#: Up to so many types, a small repository's cases are drawn and decided beside its modules.
FEW_TYPES = 256

MODULES = ("scope", "dir", "resource_types", "reuse_count")


def written(rows: DataFrame, label: str) -> DataFrame:
    """Rows that several legs read, written once to the shared folder; of what is small there, Spark knows that it is."""
    at = scratch_path(rows.sparkSession, label)
    rows.write.parquet(at)
    return rows.sparkSession.read.parquet(at)


def candidates(requests: DataFrame, groups: Column, probes: Column, modules: DataFrame, words: Column) -> DataFrame:
    """(scope, ask, dir): modules (scope, dir) that can meet a request (scope, ask).

    A request is groups of words, of which a module has to hit so many that it hits one of any `probes` groups. So only the
    rarest of them in the request's repository are looked up; a module that shares just a frequent word is never a row.
    Postings are dealt by word and by a share of the modules, so that a frequent word of a large repository is many tasks.
    """
    asked = requests.select("scope", "ask", groups.alias("groups"), probes.alias("probes")).select("scope", "ask", "probes", F.posexplode("groups").alias("g", "words"))
    asked = asked.select("scope", "ask", "probes", "g", F.explode("words").alias("word"))
    posted = modules.select("scope", "dir", F.explode(F.array_distinct(words)).alias("word"))
    often = posted.join(asked.select("scope", "word").distinct(), ["scope", "word"], "left_semi").groupBy("scope", "word").agg(F.count("*").alias("n"))
    met = asked.join(often, ["scope", "word"])  # a word that no module has can't be hit
    cost = asked.select("scope", "ask", "g", "probes").distinct().join(met.groupBy("scope", "ask", "g").agg(F.sum("n").alias("n")), ["scope", "ask", "g"], "left")
    place = F.row_number().over(Window.partitionBy("scope", "ask").orderBy(F.coalesce("n", F.lit(0)), "g"))
    rare = cost.withColumn("place", place).filter("place <= probes").select("scope", "ask", "g")
    probe = met.join(rare, ["scope", "ask", "g"]).select("scope", "ask", "word").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    share = F.pmod(F.xxhash64("dir"), F.lit(SHARES)).cast("int")
    return posted.withColumn("share", share).join(probe, ["scope", "word", "share"]).select("scope", "ask", "dir").distinct()


def _best(rows: DataFrame, top: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("scope", "ask").orderBy(*order))).filter(F.col("rank") <= top)


def _by_size(modules: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(few, large): (scope, modules) of each repository of at most FEW modules, an array of their rows; the scopes of larger
    ones, none if there are none, as is usual."""
    large = written(modules.groupBy("scope").agg(F.count("*").alias("n")).filter(F.col("n") > FEW).select("scope"), "large")
    none = large.isEmpty()
    rest = modules if none else modules.join(large, "scope", "left_anti")
    rows = rest.filter("scope is not null and dir is not null").select("scope", F.struct("dir", "resource_types", "reuse_count").alias("m"))
    return rows.groupBy("scope").agg(F.collect_list("m").alias("modules")), None if none else large


def _first(rows: Column, top: int, key: Callable[[Column], Column]) -> Column:
    """The first rows of an array (dir, reuse_count, ...) by a key, then by reuse, of nulls last, and dir."""
    order = F.transform(rows, lambda m: F.struct(key(m).alias("key"), m["reuse_count"].isNull().alias("unknown"), (-m["reuse_count"]).alias("reuse"), m["dir"].alias("dir")))
    return F.slice(F.array_sort(order), 1, top)


def _folded(requests: DataFrame, ask: Column, rank: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Requests that ask a repository for the same are ranked once."""
    rows = requests.withColumn("ask", ask)
    return rows.join(rank(rows.select("scope", "ask").distinct()), ["scope", "ask"]).drop("ask")


def rank_requests(requests: DataFrame, modules: DataFrame, top: int = 3) -> DataFrame:
    """The columns of requests (scope, intent, ...) with (dir, score, rank): what catalog.planner_rank gives for each request
    over the modules (scope, dir, resource_types, reuse_count) of its scope, all in one job. Modules are read more than once,
    so they should be a table.

    A small repository's modules are one array beside each of its requests, so that only they and the requests are moved.

    Edge cases: a null scope has no modules; a request without words, or without a module, has no rows; null types are none;
    a module that stands twice is ranked twice; other columns of requests stay, those of modules are ignored.
    """
    generic = F.array(*map(F.lit, catalog.GENERIC))
    split = lambda c: F.array_except(plain_tokens(F.translate(c, "_-", "  ")), generic)
    type_words, name_words = (lambda t: split(F.concat_ws(" ", t))), (lambda d: F.array_except(plain_tokens(d), generic))
    asked = F.array_sort(F.array_except(plain_tokens(F.col("intent")), generic))
    few, large = _by_size(modules)

    own = {"ask": asked, "groups": F.transform("__ask", catalog.with_aliases), "want": F.array_distinct(F.flatten(F.transform("__groups", lambda g: F.array_except(g, generic))))}
    rows = requests
    for name, value in own.items():  # names that a request's columns don't have
        rows = rows.withColumn(f"__{name}", value)
    words = F.transform("modules", lambda m: F.struct(m["dir"].alias("dir"), m["reuse_count"].alias("reuse_count"), type_words(m["resource_types"]).alias("types"), name_words(m["dir"]).alias("names")))
    rows = rows.filter(F.size("__ask") > 0).join(few.select("scope", words.alias("__modules")), "scope")
    n, want, groups = F.size("__ask"), F.col("__want"), F.col("__groups")
    scored = F.transform("__modules", lambda m: F.struct(
        m["dir"].alias("dir"), m["reuse_count"].alias("reuse_count"), (2 * F.size(F.array_intersect(want, m["types"])) + F.size(F.array_intersect(want, m["names"]))).alias("score"),
        F.size(F.filter(groups, lambda g: F.arrays_overlap(g, F.concat(m["types"], m["names"])))).alias("covered"),
    ))
    met = F.filter(scored, lambda m: (m["score"] > 0) & ((n > SHORT) | (2 * m["covered"] >= n)))
    best = rows.select(*requests.columns, F.posexplode(_first(met, top, lambda m: -m["score"])).alias("__place", "__m"))
    out = best.select(*requests.columns, F.col("__m.dir").alias("dir"), (-F.col("__m.key")).alias("score"), (F.col("__place") + 1).alias("rank"))
    if large is None:
        return out

    described = modules.join(large, "scope", "left_semi").select(*MODULES, type_words(F.col("resource_types")).alias("types"), name_words(F.col("dir")).alias("names"))

    def rank(asks: DataFrame) -> DataFrame:
        n = F.size("ask")
        groups = F.transform("ask", lambda w: F.array_except(catalog.with_aliases(w), generic))
        probes = F.when(n <= SHORT, n - F.ceil(n / 2) + 1).otherwise(n)
        found = candidates(asks, groups, probes, described, F.concat("types", "names")).join(described, ["scope", "dir"])
        want = F.array_distinct(F.flatten(groups))
        covered = F.size(F.filter("ask", lambda w: F.arrays_overlap(catalog.with_aliases(w), F.concat("types", "names"))))
        score = 2 * F.size(F.array_intersect(want, F.col("types"))) + F.size(F.array_intersect(want, F.col("names")))
        rows = found.select("scope", "ask", "dir", "reuse_count", score.alias("score"), covered.alias("covered"), n.alias("n"))
        rows = rows.filter((F.col("score") > 0) & ((F.col("n") > SHORT) | (2 * F.col("covered") >= F.col("n"))))
        return _best(rows, top, F.desc("score"), F.desc("reuse_count"), F.col("dir")).select("scope", "ask", "dir", "score", "rank")

    return out.unionByName(_folded(requests.join(large, "scope", "left_semi"), asked, rank))


def _grams(text: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Distinct runs of so many characters."""
    of = lambda k: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(k))), lambda g: F.length(g) == k)
    return F.array_distinct(F.concat(*map(of, sizes)))


def _tier(t: Column, key: Column, types: Column) -> Column:
    exact = (key == t) | F.coalesce(F.array_contains(types, t), F.lit(False))
    part = F.contains(key, t) | F.coalesce(F.exists(types, lambda x: F.contains(x, t)), F.lit(False))
    return F.when(exact, 2).when(part, 1)


def find_modules(requests: DataFrame, modules: DataFrame) -> DataFrame:
    """The columns of requests (scope, resource_type, ...) with (dir): what requests.find_module gives for each, all in one job.
    A key or type that holds the wanted one holds its rarest run of three characters, which is what is looked up.

    Edge cases as in rank_requests; an empty or null type finds nothing.
    """
    few, large = _by_size(modules)
    lowered = F.transform("modules", lambda m: F.struct(m["dir"].alias("dir"), m["reuse_count"].alias("reuse_count"), F.lower(m["dir"]).alias("key"), F.transform(m["resource_types"], F.lower).alias("types")))
    rows = requests.withColumn("__ask", F.lower("resource_type")).filter("__ask <> ''").join(few.select("scope", lowered.alias("__modules")), "scope")
    tiers = F.transform("__modules", lambda m: F.struct(m["dir"].alias("dir"), m["reuse_count"].alias("reuse_count"), _tier(F.col("__ask"), m["key"], m["types"]).alias("tier")))
    best = _first(F.filter(tiers, lambda m: m["tier"].isNotNull()), 1, lambda m: -m["tier"])
    out = rows.select(*requests.columns, F.explode(best).alias("__m")).select(*requests.columns, F.col("__m.dir").alias("dir"))
    if large is None:
        return out

    described = modules.join(large, "scope", "left_semi").select(*MODULES, F.lower("dir").alias("key"), F.transform("resource_types", F.lower).alias("types"))

    def rank(asks: DataFrame) -> DataFrame:
        asks = asks.filter("ask <> ''")
        own = F.when(F.length("ask") >= 3, _grams(F.col("ask"), (3,))).otherwise(F.array("ask"))
        within = F.array_distinct(F.flatten(F.transform(F.concat(F.array("key"), F.coalesce("types", F.array().cast("array<string>"))), lambda x: _grams(x))))
        found = candidates(asks, F.transform(own, lambda g: F.array(g)), F.lit(1), described, within).join(described, ["scope", "dir"])
        rows = found.withColumn("tier", _tier(F.col("ask"), F.col("key"), F.col("types"))).filter("tier is not null")
        return _best(rows, 1, F.desc("tier"), F.desc("reuse_count"), F.col("dir")).select("scope", "ask", "dir")

    return out.unionByName(_folded(requests.join(large, "scope", "left_semi"), F.lower("resource_type"), rank))


def _draw(seed: int, *c: str | Column) -> Column:
    """A number below 2^32 that a seed and some values fix."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *c).cast("binary")), 1, 8), 16, 10).cast("long")


def words_of(type_: Column) -> Column:
    return F.translate(F.substring(type_, 5, 1 << 30), "_", " ")


def _is_provided(type_: Column) -> Column:
    return F.regexp_like(type_, F.lit(PROVIDER_TYPE)) & (F.length(F.translate(F.substring(type_, 5, 1 << 30), "_", "")) > 0)


def _usable(modules: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows, usable): modules with their provider types, and of each repository with two that have some the one drawn."""
    provided = F.array_sort(F.array_distinct(F.filter("resource_types", _is_provided)))
    rows = modules.select("scope", "dir", "resource_types", provided.alias("provided"))
    return rows, rows.filter(F.size("provided") > 0).groupBy("scope").agg(F.count("*").alias("n"), F.min(F.struct(_draw(seed, "scope", "dir").alias("draw"), "dir", F.get("provided", F.lit(0)).alias("want"))).alias("best")).filter("n >= 2")


def positives(modules: DataFrame, seed: int = 42) -> DataFrame:
    """The positive cases alone, which need one pass."""
    usable = _usable(modules, seed)[1]
    return usable.select("scope", F.lit("positive").alias("kind"), F.col("best.want").alias("want")).withColumn("intent", words_of(F.col("want")))


def cases(modules: DataFrame, seed: int = 42) -> DataFrame:
    """(scope, kind, want, intent): for each repository with two modules of provider types at least, the first type of a module
    drawn at random (`positive`) and a type drawn at random that shares no word with any module of the repository (`negative`).

    Types are numbered. The negative is the first number, from a start drawn for the repository, that its words don't block:
    the first gap in its blocked numbers. Nothing pairs repositories with all types; a repository without a gap has no negative.
    The numbered types are written, so that Spark knows whether they are few: then blocked numbers stay where their
    repository's words are.
    """
    rows, usable = _usable(modules, seed)
    inside = rows.join(usable.select("scope"), "scope", "left_semi")
    return _cases(modules, _numbered(inside.select(F.explode("provided").alias("want"))), seed)


def _numbered(types: DataFrame) -> DataFrame:
    """(want, number, total) of each type that stands among some (want)."""
    types = types.distinct().withColumn("range", _draw(0, "want") % RANGES)
    types = types.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy("want")) - 1)
    ranges = types.groupBy("range").agg(F.count("*").alias("size"))  # RANGES rows
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("first"), F.sum("size").over(Window.partitionBy()).alias("total"))
    return written(types.join(F.broadcast(ranges), "range").select("want", (F.col("first") + F.col("at")).alias("number"), "total"), "types")


def _cases(modules: DataFrame, numbered: DataFrame, seed: int) -> DataFrame:
    rows, usable = _usable(modules, seed)
    inside = rows.join(usable.select("scope"), "scope", "left_semi")
    said = inside.repartition("scope").select("scope", F.explode(plain_tokens(F.translate(F.concat_ws(" ", "dir", F.concat_ws(" ", "resource_types")), "_", " "))).alias("word")).distinct()
    blocked = said.join(numbered.select("number", "total", F.explode(F.array_distinct(plain_tokens(words_of(F.col("want"))))).alias("word")), "word").select("scope", "number", "total").distinct()
    turned = blocked.withColumn("start", F.pmod(_draw(seed, "scope"), F.col("total"))).withColumn("turned", F.pmod(F.col("number") - F.col("start"), F.col("total")))
    turned = turned.withColumn("nth", F.row_number().over(Window.partitionBy("scope").orderBy("turned")) - 1)
    gaps = turned.groupBy("scope", "start", "total").agg(F.coalesce(F.min(F.when(F.col("turned") != F.col("nth"), F.col("nth"))), F.count("*")).alias("gap")).filter("gap < total")
    free = gaps.select("scope", F.pmod(F.col("gap") + F.col("start"), F.col("total")).alias("number"))
    negative = free.join(numbered, "number").select("scope", F.lit("negative").alias("kind"), "want")
    return positives(modules, seed).unionByName(negative.withColumn("intent", words_of(F.col("want"))))


def decisions(asked: DataFrame, modules: DataFrame) -> DataFrame:
    """(scope, kind, want, who, dir, strict, lenient): what the planner and the composer take for each case, null for nothing;
    strict if the module has the wanted type, lenient if it is at least related to it."""
    planner = rank_requests(asked, modules, top=1).select("scope", "kind", F.lit("planner").alias("who"), "dir")
    composer = find_modules(asked.withColumn("resource_type", F.translate("intent", " ", "_")), modules).select("scope", "kind", F.lit("compose").alias("who"), "dir")
    told = planner.unionByName(composer).join(modules.select("scope", "dir", "resource_types"), ["scope", "dir"])
    every = asked.select("scope", "kind", "want", F.explode(F.array(F.lit("planner"), F.lit("compose"))).alias("who"))
    rows = every.join(told, ["scope", "kind", "who"], "left")
    strict = F.coalesce(F.array_contains("resource_types", F.col("want")), F.lit(False))
    related = F.col("dir").isNotNull() & catalog.module_relates(F.substring("want", 5, 1 << 30), F.col("dir"), F.col("resource_types"))
    return rows.select("scope", "kind", "want", "who", "dir", strict.alias("strict"), (strict | related).alias("lenient"))


def described(modules: DataFrame) -> DataFrame:
    """Modules with what they say (about): their words, the first of their provider types, all as one lower-cased text. It depends
    on dir and types alone, so where many repositories share modules it is best asked before they are dealt to them."""
    first = F.array_min(F.filter("resource_types", _is_provided))
    words = plain_tokens(F.concat_ws(" ", "resource_types")).alias("types"), plain_tokens(F.col("dir")).alias("names")
    return modules.withColumn("about", F.struct(first.alias("first"), *words, F.lower(F.concat_ws("\n", "dir", "resource_types")).alias("text")))


def lots(modules: DataFrame, seed: int = 42) -> DataFrame:
    """(scope, n, typed, modules): the n modules of each repository in arrays of at most FEW, each with its place among equals and what
    it says, and a number drawn if it has a provider type, as typed of them have. One shuffle by repository; none if modules come dealt by scope."""
    order = Window.partitionBy("scope").orderBy(F.desc("reuse_count"), "dir")
    rows = modules if "about" in modules.columns else described(modules)
    rows = rows.select(*MODULES, "about", F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy("scope")).alias("n"))
    m = F.struct("k", "dir", "resource_types", "reuse_count", F.when(F.col("about.first").isNotNull(), _draw(seed, "scope", "dir")).alias("draw"), "about.*")
    rows = rows.select("scope", "n", F.floor((F.col("k") - 1) / max(FEW, 1)).alias("lot"), m.alias("m"))
    return rows.groupBy("scope", "n", "lot").agg(F.count("m.first").alias("typed"), F.collect_list("m").alias("modules")).drop("lot")


def _requests_of(want: Column) -> list[Column]:
    """What a case of a type asks of the planner (ask, wanted, groups), of the composer (type) and of a related module (related)."""
    without = lambda words, *no: F.array_except(words, F.array(*map(F.lit, no)))
    ask, said = without(plain_tokens(words_of(want)), *catalog.GENERIC), F.substring(want, 5, 1 << 30)
    groups = F.transform(ask, catalog.with_aliases)
    related = F.flatten(F.transform(F.concat(F.array(F.lower(said)), plain_tokens(said)), catalog.with_aliases))
    wanted = without(F.array_distinct(F.flatten(groups)), *catalog.GENERIC)
    return [groups.alias("groups"), wanted.alias("wanted"), F.lower(F.translate(words_of(want), " ", "_")).alias("type"), without(F.array_distinct(related), "aws").alias("related")]


def _decided(rows: DataFrame, numbered: DataFrame, seed: int) -> DataFrame:
    """What decisions(cases) gives for repositories in one array each (scope, modules), without a shuffle: few numbered types
    stand beside each."""
    numbered = numbered.withColumn("words", F.array_distinct(plain_tokens(words_of(F.col("want")))))
    by_word = numbered.select("number", F.explode("words").alias("word")).groupBy("word").agg(F.collect_list("number").alias("numbers"))
    blocks = by_word.agg(F.map_from_entries(F.collect_list(F.struct("word", "numbers"))).alias("blocks"))
    every = numbered.agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "want"))), lambda t: t["want"]).alias("wants"), F.array_sort(F.collect_list("number")).alias("numbers"))
    rows = rows.filter("typed >= 2").crossJoin(F.broadcast(every.crossJoin(blocks)))

    drawn = F.filter("modules", lambda m: m["draw"] == F.col("draw"))
    best = F.array_min(F.transform(drawn, lambda m: F.struct(m["dir"], m["first"].alias("want"))))["want"]
    start = F.when(F.col("scope").isNotNull() & (F.size("wants") > 0), F.pmod(_draw(seed, "scope"), F.greatest(F.size("wants"), F.lit(1))))
    said = F.concat(F.flatten("modules.types"), F.flatten("modules.names"))
    rows = rows.withColumns({"draw": F.array_min("modules.draw"), "said": said, "start": start})
    blocked = F.flatten(F.transform(F.array_intersect(F.map_keys("blocks"), F.col("said")), lambda w: F.col("blocks")[w]))
    rows = rows.select("scope", "modules", "wants", "said", "start", best.alias("positive"), F.array_except("numbers", blocked).alias("free"))
    number = F.coalesce(F.array_min(F.filter("free", lambda f: f >= F.col("start"))), F.array_min("free"))  # round from the start
    negative = F.when(F.col("start").isNotNull(), F.get("wants", number.cast("int")))
    case = lambda kind, want: F.struct(F.lit(kind).alias("kind"), want.alias("want"))
    asked = F.array(case("positive", F.col("positive")), case("negative", negative))
    rows = rows.select("scope", "modules", "said", F.inline(asked)).filter("want is not null").join(F.broadcast(numbered.select("want", *_requests_of(F.col("want")))), "want", "left")

    hits = lambda words: F.size(F.array_intersect(F.col("wanted"), words))
    best = lambda rate, m: F.struct(rate.alias("rate"), (-m["k"]).alias("place"), m.alias("m"))
    scored = F.filter(F.transform("modules", lambda m: best(2 * hits(m["types"]) + hits(m["names"]), m)), lambda r: (r["rate"] > 0) & r["m"]["dir"].isNotNull())
    n = F.size("groups")
    covered = lambda m: F.size(F.filter("groups", lambda g: F.arrays_overlap(g, F.concat(m["types"], m["names"]))))
    planner = F.array_max(F.filter(scored, lambda r: (n > SHORT) | (2 * covered(r["m"]) >= n)))
    tier = lambda m: _tier(F.col("type"), F.lower(m["dir"]), F.transform(m["resource_types"], F.lower))
    holds = F.filter("modules", lambda m: F.contains(m["text"], F.col("type")) & m["dir"].isNotNull())  # else neither its key nor a type does
    compose = F.array_max(F.filter(F.transform(holds, lambda m: best(tier(m), m)), lambda r: r["rate"].isNotNull()))
    known = F.col("scope").isNotNull()
    told = rows.withColumns({"planner": F.when(known & F.arrays_overlap("wanted", "said"), planner)["m"], "compose": F.when(known, compose)["m"]})

    def verdict(who: str) -> Column:
        m = F.col(who)
        strict = F.coalesce(F.array_contains(m["resource_types"], F.col("want")), F.lit(False))
        related = F.coalesce(F.arrays_overlap("related", m["types"]) | F.arrays_overlap("related", m["names"]), F.lit(False))
        return F.struct(F.lit(who).alias("who"), m["dir"].alias("dir"), strict.alias("strict"), (strict | related).alias("lenient"))

    return told.select("scope", "kind", "want", F.inline(F.array(verdict("planner"), verdict("compose"))))


def sweep(modules: DataFrame, seed: int = 42) -> DataFrame:
    """The decisions on the cases of many repositories: modules are written once, as an array of each repository. Small ones are
    decided beside their array; the modules of larger ones, and of all if there are more than FEW_TYPES types, are rows again."""
    kept = written(lots(modules, seed), "lots")
    usable, large = kept.filter("scope is not null"), F.col("n") > FEW
    none = kept.filter(large).isEmpty()
    lists = usable.filter(~large & (F.col("typed") >= 2))
    if not none:
        more = usable.filter(large)
        lists = lists.unionByName(more.join(more.groupBy("scope").agg(F.sum("typed").alias("all")).filter("all >= 2").select("scope"), "scope", "left_semi"))
    lists = written(lists.select(F.explode("modules.resource_types").alias("types")).distinct(), "lists")  # repositories share them
    numbered = _numbered(lists.select(F.explode("types").alias("want")).filter(_is_provided(F.col("want"))))
    if numbered.count() > FEW_TYPES:
        large, none = F.lit(True), False
    out = _decided(kept.filter(~large), numbered, seed)
    if none:
        return out
    rest = written(kept.filter(large).select("scope", F.explode("modules").alias("m")).select("scope", "m.dir", "m.resource_types", "m.reuse_count"), "modules")
    return out.unionByName(decisions(written(_cases(rest, numbered, seed), "cases"), rest))


def report(rows: DataFrame, min_lenient: float = MIN_LENIENT, max_false_reuse: float = MAX_FALSE_REUSE) -> DataFrame:
    """(who, positives, strict, lenient, negatives, false_reuse, ok), shares over the cases of their kind; of none, zero."""
    positive, negative = F.col("kind") == "positive", F.col("kind") == "negative"
    share = lambda hit, kind: F.count_if(hit & kind) / F.greatest(F.count_if(kind), F.lit(1))
    out = rows.groupBy("who").agg(
        F.count_if(positive).alias("positives"), share(F.col("strict"), positive).alias("strict"), share(F.col("lenient"), positive).alias("lenient"),
        F.count_if(negative).alias("negatives"), share(F.col("dir").isNotNull(), negative).alias("false_reuse"),
    )
    return out.withColumn("ok", (F.col("lenient") >= min_lenient) & (F.col("false_reuse") <= max_false_reuse))
