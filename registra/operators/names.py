"""Name search: the best establishments for each name of a list, one per legal unit.

The answer is the best `limit` of all names, so no score can be excluded beforehand. It is found by threshold joins:
  1. Registry rows collapse to names, with the few legal units that can matter, over all postcodes and per postcode.
  2. Some names that share a query's rarest letter sequences are scored. The score of the `limit`-th legal unit among
     them is the floor of the query and its postcode: whatever scores less cannot be part of the answer.
  3. Names with the same bytes and the same beginning share a signature, which is enough for a ceiling of the score. A floor
     asks for so many bytes in common that, of each length and beginning of names, only those can reach it that have one of
     their own rarest bytes in common with the query's rarest: an equi-join of signatures. Pairs below the floor go.
  4. The remaining pairs of names are scored in full, those with high ceilings first (`BANDS`): the best so far are kept for
     each query, and their floor leaves less to the next band.
The scope is everything, or a postcode, where the floor is lower by the bonus. Names without a byte in common score 0; of those
only the lowest SIRETs can be part of an answer, and these are candidates of every query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.functions.naming import without_legal_form
from registra.functions.similarity import BOOST_ABOVE, PREFIX_LENGTH, PREFIX_WEIGHT, name_similarity
from registra.functions.text import search_link
from registra.operators.establishments import by_siret, first_per_key
from registra.operators.held import held
from registra.sources.registry import Registry

SHORTEST_NAME = 3
POSTCODE_BONUS = 0.05
# What a query's floor is taken from: so many of its rarest letter sequences, and so many names of each. Neither changes results.
RARE_SEQUENCES = 4
NAMES_PER_SEQUENCE = 16
# Lower ends of the bands of ceilings that are scored one after another. They do not change results either.
BANDS = (0.975, 0.95, -2.0)
REPETITIONS = 1 << 20  # more than a name repeats a byte
SLACK = 1e-6  # between a ceiling and a score
RANKING_DIGITS = 10  # scores equal to this many digits are ties, settled by SIRET

# Name columns in order of preference, and the parts of the short address.
SHORT_ADDRESS = (
    "numeroVoieEtablissement",
    "typeVoieEtablissement",
    "libelleVoieEtablissement",
    "codePostalEtablissement",
    "libelleCommuneEtablissement",
)


def _given(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def search_name() -> Column:
    return F.coalesce(
        _given("denominationUniteLegale"),
        _given("denominationUsuelle1UniteLegale"),
        _given("denominationUsuelleEtablissement"),
        _given("enseigne1Etablissement"),
        _given("nomUniteLegale"),
    )


def short_address() -> Column:
    return F.trim(F.concat_ws(" ", *[_given(n) for n in SHORT_ADDRESS]))


def _named(registry: Registry, establishments: DataFrame) -> DataFrame:
    units = registry.legal_units.select(
        "siren", "denominationUniteLegale", "denominationUsuelle1UniteLegale", "nomUniteLegale"
    )
    return establishments.join(units, "siren").withColumn("denomination", search_name())


def prepare_queries(lines: DataFrame, row_id: str, name: str, postcode: str | None = None) -> DataFrame:
    """(row_id, clean, zip) of the lines long enough to search."""
    given = F.trim(F.col(f"`{name}`"))
    zip_code = F.trim(F.coalesce(F.col(f"`{postcode}`"), F.lit(""))) if postcode else F.lit("")
    return (
        lines.select(F.col(f"`{row_id}`").alias("row_id"), given.alias("_name"), zip_code.alias("zip"))
        .filter(F.length("_name") >= SHORTEST_NAME)
        .select("row_id", without_legal_form(F.col("_name")).alias("clean"), "zip")
        .filter(F.length("clean") >= SHORTEST_NAME)
    )


def registry_places(registry: Registry, limit: int) -> DataFrame:
    """(place_name, postcode, siren, siret): up to `limit` legal units for each name and postcode."""
    rows = registry.establishments.select(
        "siret", "siren", "denominationUsuelleEtablissement", "enseigne1Etablissement",
        F.coalesce("codePostalEtablissement", F.lit("")).alias("postcode"),
    )
    named = (
        _named(registry, rows)
        .select(without_legal_form(F.col("denomination")).alias("place_name"), "postcode", "siren", "siret")
        .filter(F.col("place_name").isNotNull())
    )
    lowest = named.groupBy("place_name", "postcode", "siren").agg(F.min("siret").alias("siret"))
    window = Window.partitionBy("place_name", "postcode").orderBy("siret")
    return lowest.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= limit).drop("_rank")


def _described(names: DataFrame, name: str) -> DataFrame:
    """`names` with `bytes` (each byte with its repetition, as a number), `head` (the first bytes) and the `signature` of both."""
    digits = F.hex(F.encode(F.col(name), "UTF-8"))

    def counted(each: Column) -> Column:
        def repeated(byte: Column) -> Column:
            number = F.conv(byte, 16, 10).cast("int") * REPETITIONS
            return F.transform(F.sequence(F.lit(1), F.size(F.filter(each, lambda other: other == byte))), lambda i: number + i)

        return F.flatten(F.transform(F.array_sort(F.array_distinct(each)), repeated))

    # Inside the outer transform the bytes are taken apart once, however often they are looked at.
    each = F.regexp_extract_all(digits, F.lit("(..)"), 1)
    return (
        names.withColumn("bytes", F.get(F.transform(F.array(each), counted), F.lit(0)))
        .withColumn("head", F.substring(digits, 1, 2 * PREFIX_LENGTH))
        .withColumn("signature", F.md5(F.concat_ws("|", "head", F.concat_ws(",", F.col("bytes").cast("array<string>")))))
    )


def _sequences(name: str) -> Column:
    """Distinct runs of one, two and three letters."""
    runs = [
        F.when(F.length(name) >= n, F.transform(F.sequence(F.lit(1), F.length(name) - (n - 1)), lambda i, n=n: F.substring(F.col(name), i, F.lit(n))))
        for n in (1, 2, 3)
    ]
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(run, none) for run in runs]))


def _first_pairs(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(clean, place_name) for names that share rare sequences with a query."""
    of_name = names.select("place_name", F.explode(_sequences("place_name")).alias("run"))
    of_query = wanted.select("clean", F.explode(_sequences("clean")).alias("run"))
    runs = of_name.groupBy("run").agg(F.count("*").alias("names"))
    # The rarest lead to the closest names; a floor needs several legal units, so the rarest with enough names are taken too.
    known = of_query.join(runs, "run").withColumn("enough", F.col("names") >= NAMES_PER_SEQUENCE)
    rarest = Window.partitionBy("clean", "enough").orderBy("names", F.length("run").desc(), "run")
    chosen = known.withColumn("_rank", F.row_number().over(rarest)).filter(F.col("_rank") <= RARE_SEQUENCES)
    some = Window.partitionBy("run").orderBy("place_name")
    few = of_name.withColumn("_rank", F.row_number().over(some)).filter(F.col("_rank") <= NAMES_PER_SEQUENCE)
    return chosen.select("clean", "run").join(few.select("run", "place_name"), "run").select("clean", "place_name").distinct()


def _scored(pairs: DataFrame) -> DataFrame:
    return pairs.select("clean", "place_name", name_similarity(F.col("clean"), F.col("place_name")).alias("base"))


def _best(scored: DataFrame, distinct: DataFrame, places: DataFrame, holders: DataFrame, limit: int, known: DataFrame | None = None) -> DataFrame:
    """(clean, zip, siren, siret, score, rank) of the best `limit` legal units among scored pairs and those `known` as such."""
    order = [F.col("score").desc(), F.col("siret").asc()]
    anywhere = scored.join(holders, "place_name").select("clean", "siren", "siret", F.round("base", RANKING_DIGITS).alias("score"))
    anywhere = first_per_key(anywhere, ["clean", "siren"], order)
    per_name = Window.partitionBy("clean").orderBy(*order)
    anywhere = anywhere.withColumn("_rank", F.row_number().over(per_name)).filter(F.col("_rank") <= limit).drop("_rank")
    near = (
        scored.join(distinct.filter("zip <> ''"), "clean")
        .join(places.withColumnRenamed("postcode", "zip"), ["place_name", "zip"])
        .select("clean", "zip", "siren", "siret", F.round(F.least(F.lit(1.0), F.col("base") + POSTCODE_BONUS), RANKING_DIGITS).alias("score"))
    )
    found = anywhere.join(distinct, "clean").select("clean", "zip", "siren", "siret", "score").unionByName(near)
    if known is not None:
        found = found.unionByName(known.drop("rank"))
    per_unit = first_per_key(found, ["clean", "zip", "siren"], order)
    per_query = Window.partitionBy("clean", "zip").orderBy(*order)
    return per_unit.withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= limit)


def _floors(distinct: DataFrame, best: DataFrame, limit: int) -> DataFrame:
    """`distinct` with `floor`, the score of the `limit`-th legal unit found so far, or -1."""
    last = best.filter(F.col("rank") == limit).select("clean", "zip", F.col("score").alias("floor"))
    return distinct.join(last, ["clean", "zip"], "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0)))


def _least_jaro(floor: Column, same: int = PREFIX_LENGTH) -> Column:
    """The Jaro similarity that a score needs at least with so many first bytes in common, by default the most that count."""
    boost = same * PREFIX_WEIGHT
    boosted = (floor - boost) / (1 - boost)
    return F.when(floor <= BOOST_ABOVE, floor).otherwise(F.greatest(F.lit(BOOST_ABOVE), boosted))


def _ceiling(common: Column, one: Column, other: Column, head: Column, other_head: Column, crossed: Column | None = None) -> Column:
    """Highest score of names of these lengths, with so many bytes in common and these beginnings.

    `crossed`: two bytes that both names have once come in another order. Matched, they are a transposition; else one is missing.
    """
    jaro = (common / one + common / other + 1) / 3
    if crossed is not None:
        swapped = (common / one + common / other + 1 - 1 / common) / 3
        without = ((common - 1) / one + (common - 1) / other + 1) / 3
        jaro = F.when(crossed, F.greatest(swapped, without)).otherwise(jaro)
    same = F.lit(0)
    for n in range(PREFIX_LENGTH, 0, -1):
        equal = F.substring(head, 1, 2 * n) == F.substring(other_head, 1, 2 * n)
        same = F.when(equal, F.lit(n)).otherwise(same) if n == PREFIX_LENGTH else F.when((same == 0) & equal, F.lit(n)).otherwise(same)
    # A ceiling just under the boost threshold may round either way.
    return F.when(jaro >= BOOST_ABOVE - SLACK, jaro + same * PREFIX_WEIGHT * (1 - jaro)).otherwise(jaro)


def _alone(head: str, counted: str) -> Column:
    """Bytes of a beginning that its name has once, in their order."""
    first = [F.conv(F.substring(head, 1 + 2 * n, 2), 16, 10).cast("int") * REPETITIONS for n in range(PREFIX_LENGTH)]
    there = F.slice(F.array(*first), F.lit(1), F.least(F.lit(PREFIX_LENGTH), F.size(counted)))
    return F.filter(there, lambda byte: ~F.array_contains(F.col(counted), byte + 2))


def _place_signatures(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct signatures of `names` (scope, signature, bytes, head), and their bytes by rarity, one row each."""
    places = names.groupBy("scope", "signature").agg(F.first("bytes").alias("place_bytes"), F.first("head").alias("place_head"))
    places = places.withColumn("place", F.monotonically_increasing_id()).withColumn("place_alone", _alone("place_head", "place_bytes"))
    places = held(places, "place_signatures")
    # One row for each byte with its repetition; lengths of names are few, whatever their number.
    bytes_ = places.select("scope", "place", "place_head", F.size("place_bytes").alias("length"), F.explode("place_bytes").alias("byte"))
    often = bytes_.groupBy("byte").agg(F.count("*").alias("names"))
    by_rarity = Window.partitionBy("place").orderBy("names", "byte")
    return places, held(bytes_.join(often, "byte").withColumn("place_rank", F.row_number().over(by_rarity)), "postings")


def _signature_pairs(wanted: DataFrame, places: DataFrame, postings: DataFrame, low: float, high: float) -> DataFrame:
    """(scope, signature, place_signature, ceiling) of all signatures that can reach the lowest floor of theirs, with a ceiling from `low` to below `high`.

    `wanted` has (scope, signature, bytes, head, floor).
    """
    asked = wanted.groupBy("scope", "signature").agg(F.first("bytes").alias("bytes"), F.first("head").alias("head"), F.min("floor").alias("floor"))
    asked = asked.filter(F.col("floor") - SLACK < high).withColumn("query", F.monotonically_increasing_id())
    asked = held(asked.withColumn("alone", _alone("head", "bytes")).withColumn("aim", F.greatest("floor", F.lit(low))), "query_signatures")
    often = postings.select("byte", "names").distinct()
    lengths = sorted(r["length"] for r in postings.select("length").distinct().collect())
    rarity = asked.select("query", "scope", "head", F.size("bytes").alias("own"), "aim", F.explode("bytes").alias("byte")).join(often, "byte", "left")
    by_rarity = Window.partitionBy("query").orderBy(F.coalesce("names", F.lit(0)), "byte")
    ranked = rarity.withColumn("rank", F.row_number().over(by_rarity)).filter("names IS NOT NULL")
    own, other, sames = F.col("own"), F.col("length"), range(PREFIX_LENGTH + 1)

    def least(same: int) -> Column:
        needed = (3 * _least_jaro(F.col("aim") - SLACK, same) - 1) * own * other / (own + other)
        return F.greatest(F.lit(1), F.ceil(needed - SLACK)).cast("int")

    # A pair is met by the number of first bytes it has in common: the more, the fewer bytes it needs elsewhere.
    asks = F.explode(F.array(*[F.struct(F.lit(n).alias("same"), F.substring("head", 1, 2 * n).alias("start"), least(n).alias("least")) for n in sames]))
    probes = (
        ranked.select("*", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("length"))
        .select("query", "scope", "own", "byte", "rank", "length", asks.alias("ask"))
        .select("query", "scope", "own", "byte", "rank", "length", "ask.*")
        .filter((F.col("least") <= F.least(own, other)) & (F.col("rank") <= own - F.col("least") + 1))
        .select("query", "scope", "length", "byte", "same", "start", "least")
    )
    starts = F.explode(F.array(*[F.struct(F.lit(n).alias("same"), F.substring("place_head", 1, 2 * n).alias("start")) for n in sames]))
    filed = postings.select("scope", "place", "length", "byte", "place_rank", starts.alias("at")).select("scope", "place", "length", "byte", "place_rank", "at.*")
    met = probes.join(filed, ["scope", "length", "byte", "same", "start"]).filter(F.col("place_rank") <= other - F.col("least") + 1)
    both = met.select("query", "place").distinct().join(asked, "query").join(places.drop("scope").withColumnRenamed("signature", "place_signature"), "place")
    common = F.size(F.array_intersect("bytes", "place_bytes"))
    crossed = F.array_intersect("alone", "place_alone") != F.array_intersect("place_alone", "alone")
    reach = _ceiling(common, F.size("bytes"), F.size("place_bytes"), F.col("head"), F.col("place_head"), crossed)
    both = both.withColumn("ceiling", reach).filter((F.col("ceiling") >= F.greatest(F.col("floor") - SLACK, F.lit(low))) & (F.col("ceiling") < high))
    return both.select("scope", "signature", "place_signature", "ceiling")


def _lowest(holders: DataFrame, limit: int) -> list[str]:
    """Names of the legal units with the lowest SIRETs of all: the answer where nothing has a byte in common."""
    per_unit = holders.groupBy("siren").agg(F.min(F.struct("siret", "place_name")).alias("first"))
    return [r["name"] for r in per_unit.orderBy("first.siret").limit(limit).select(F.col("first.place_name").alias("name")).collect()]


def _searched(distinct: DataFrame, places: DataFrame, holders: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The best of each query (`_best`), and (clean, place_name, base) of every pair that was compared for it."""
    known = held(_described(holders.select("place_name").distinct(), "place_name"), "known_names")
    wanted = held(_described(distinct.select("clean").distinct(), "clean"), "wanted_names")
    everything = F.lit("")
    near = distinct.filter("zip <> ''").select("clean", F.col("zip").alias("scope"))
    first = _first_pairs(wanted, known)
    # Nothing in common: the lowest SIRETs of all, and of the postcode.
    lowest = F.array(*[F.lit(name) for name in _lowest(holders, limit)]).cast("array<string>")
    first = first.unionByName(wanted.select("clean", F.explode(lowest).alias("place_name")))
    in_zip = Window.partitionBy("postcode").orderBy("siret")
    first_there = places.filter("postcode <> ''").groupBy("postcode", "siren").agg(F.min(F.struct("siret", "place_name")).alias("first"))
    first_there = first_there.select("postcode", "first.siret", "first.place_name").withColumn("_rank", F.row_number().over(in_zip)).filter(F.col("_rank") <= limit)
    first = first.unionByName(near.join(first_there.select(F.col("postcode").alias("scope"), "place_name"), "scope").select("clean", "place_name"))
    scored = held(_scored(first.distinct()), "first_pairs")
    best = held(_best(scored, distinct, places, holders, limit), "best")

    there = places.filter("postcode <> ''").select("place_name", F.col("postcode").alias("scope")).distinct()
    given = known.withColumn("scope", everything).unionByName(known.join(there, "place_name"))
    signatures, postings = _place_signatures(given)
    high = 2.0
    for low in BANDS:
        floors = _floors(distinct, best, limit)
        anywhere = floors.groupBy("clean").agg(F.min("floor").alias("floor")).withColumn("scope", everything)
        there = floors.filter("zip <> ''").select("clean", (F.col("floor") - POSTCODE_BONUS).alias("floor"), F.col("zip").alias("scope"))
        asked = held(wanted.join(anywhere.unionByName(there), "clean"), "asked")
        reached = held(_signature_pairs(asked, signatures, postings, low, high), "signature_pairs")
        pairs = (
            reached.join(asked.select("scope", "signature", "clean", "floor"), ["scope", "signature"])
            .filter(F.col("ceiling") >= F.col("floor") - SLACK)
            .join(given.select("scope", F.col("signature").alias("place_signature"), "place_name"), ["scope", "place_signature"])
            .select("clean", "place_name")
            .distinct()
        )
        more = held(_scored(pairs), "scored_names")
        best = held(_best(more, distinct, places, holders, limit, best), "best")
        scored, high = scored.unionByName(more), low
    return best, scored


def compared_names(distinct: DataFrame, places: DataFrame, holders: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Floors of the names asked for, and (clean, place_name, base) of every pair that can be part of an answer.

    `distinct` has (clean, zip), `places` those of `registry_places`, `holders` up to `limit` legal units of each name.
    """
    best, scored = _searched(distinct, places, holders, limit)
    return _floors(distinct, best, limit).groupBy("clean").agg(F.min("floor").alias("floor")), scored.distinct()


def search_names(queries: DataFrame, registry: Registry, limit: int = 3) -> DataFrame:
    """(row_id, rank, siret, denomination, adresse, score_similarite) for prepared queries."""
    places = held(registry_places(registry, limit), "places")
    per_name = Window.partitionBy("place_name").orderBy("siret")
    holders = places.groupBy("place_name", "siren").agg(F.min("siret").alias("siret"))
    holders = held(holders.withColumn("_rank", F.row_number().over(per_name)).filter(F.col("_rank") <= limit).drop("_rank"), "holders")
    distinct = held(queries.select("clean", "zip").distinct(), "names")
    ranked, _ = _searched(distinct, places, holders, limit)

    shown = by_siret(registry.establishments, ranked).select(
        "siret", "siren", "denominationUsuelleEtablissement", "enseigne1Etablissement", *SHORT_ADDRESS
    )
    described = _named(registry, shown).select("siret", "denomination", short_address().alias("adresse"))
    described = first_per_key(described, ["siret"], [F.col("denomination"), F.col("adresse")])
    return queries.join(ranked.join(described, "siret"), ["clean", "zip"]).select(
        "row_id", "rank", "siret", "denomination", "adresse",
        F.round("score", 4).alias("score_similarite"),
    )


def candidates_wide(lines: DataFrame, row_id: str, candidates: DataFrame, limit: int = 3) -> DataFrame:
    """The list with its candidates side by side; lines without any keep empty cells."""
    cells = []
    for position in range(1, limit + 1):
        here = F.col("rank") == position
        for source, name in (
            ("siret", "suggested_siret"),
            ("denomination", "suggested_denomination"),
            ("adresse", "suggested_adresse"),
            ("score_similarite", "score"),
        ):
            cells.append(F.max(F.when(here, F.col(source))).alias(f"{name}_{position}"))
    wide = candidates.groupBy(F.col("row_id").alias(row_id)).agg(*cells)
    joined = lines.join(wide, row_id, "left")
    types = dict(wide.dtypes)
    return joined.select(
        *[F.col(f"`{c}`") for c in lines.columns],
        *[
            F.coalesce(F.col(c), F.lit("")).alias(c) if types[c] == "string" else F.col(c)
            for c in wide.columns
            if c != row_id
        ],
    )


# Spellings of the home country in the name-search list.
HOME_CODES = ("FRA", "FR", "FRANCE")


def review_priority(country: Column, first_siret: Column) -> Column:
    """1: home country with a candidate, 2: home country without, 3: anything else."""
    home = F.coalesce(F.upper(F.trim(country)).isin(*HOME_CODES), F.lit(False))
    return F.when(home & (F.coalesce(first_siret, F.lit("")) != ""), 1).when(home, 2).otherwise(3)


def search_counts(wide: DataFrame, limit: int = 3) -> DataFrame:
    """Lines with and without a candidate, and candidates in all."""
    found = [(F.col(f"suggested_siret_{i}") != "").cast("int") for i in range(1, limit + 1)]
    total = found[0]
    for one in found[1:]:
        total = total + one
    return wide.agg(
        F.count_if(total > 0).alias("lines_with_candidate"),
        F.count_if(total == 0).alias("lines_without_candidate"),
        F.coalesce(F.sum(total), F.lit(0)).alias("candidates"),
    )


def candidate_link(value: Column, base: str) -> Column:
    return search_link(base, value)


__all__: list[str] = [
    "candidate_link", "candidates_wide", "prepare_queries", "registry_places", "review_priority",
    "search_counts", "search_names",
]
