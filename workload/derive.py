"""Registry tables and user lists derived by Spark from the driver's tables.

The driver's data has no registry, so customers become legal units, orders establishments and line
items history periods. The tables are written once per session and scale to the shared folder, under
published and variant column names, so that the jobs read Parquet as they would in production.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from registra.session import shared_folder, tune
from registra.sources.registry import Registry, RegistryPaths, read_registry


@dataclass(frozen=True)
class Staged:
    registry_paths: RegistryPaths
    list_csv: str
    list_parquet: str
    names_parquet: str


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table, spread over the cores when its files are too few to feed them."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _luhn_sum(number: Column, length: int, after: int) -> Column:
    """What a number of so many digits adds to the Luhn sum of one in which `after` more follow them."""
    digits = [(number / 10 ** (length - i)).cast("int") % 10 for i in range(1, length + 1)]
    doubled = [(length - i + after) % 2 for i in range(1, length + 1)]
    return reduce(add, [d * 2 - (d > 4).cast("int") * 9 if twice else d for d, twice in zip(digits, doubled)])


def _closing_digit(luhn_sum: Column) -> Column:
    return F.pmod(10 - luhn_sum % 10, F.lit(10)).cast("string")


def check_digit(body: Column, length: int) -> Column:
    """Last digit that makes an identifier pass the Luhn key."""
    return _closing_digit(_luhn_sum(body.cast("long"), length, 1))


def _sirens(spark: SparkSession, sf: str) -> DataFrame:
    customers = source(spark, sf, "customer")
    body = (F.lit(30000000) + F.col("c_custkey")).cast("string")
    numbered = customers.withColumn("_b", body).withColumn("siren", F.concat("_b", check_digit(F.col("_b"), 8))).drop("_b")
    # Taken once a customer: five more digits follow in each SIRET.
    return numbered.withColumn("siren_sum", _luhn_sum(F.col("siren").cast("long"), 9, 5))


def establishments(spark: SparkSession, sf: str) -> DataFrame:
    orders = source(spark, sf, "orders")
    nations = spark.read.parquet(f"{sf}/nation.parquet")
    in_order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    numbered = (
        orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
        .withColumn("rn", F.row_number().over(in_order))
        # The neighbours of an order among those of its customer, which links and the list refer to.
        .withColumn("previous", F.lag("o_orderkey").over(in_order))
        .withColumn("following", F.lead(F.struct("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")).over(in_order))
    )
    joined = numbered.join(_sirens(spark, sf), F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = F.col("o_orderkey")
    created = F.col("o_orderdate").cast("date")

    def state(key: Column, order_status: Column) -> Column:
        return (
            F.when(key % 50 == 7, F.lit(None))
            .when(F.col("o_custkey") % 7 == 0, "F")
            .when(order_status == "O", "A")
            .otherwise("F")
        )

    def siret(number: Column) -> Column:
        own = F.lpad(number.cast("string"), 4, "0")
        return F.concat("siren", own, _closing_digit(F.col("siren_sum") + _luhn_sum(own.cast("int"), 4, 1)))

    street = F.when(key % 40 == 0, "[ND]").when(key % 40 == 20, "[ nd ]").otherwise(F.col("o_orderpriority"))
    return (
        joined.withColumn("siret", siret(F.col("rn")))
        .select(
            "o_orderkey", "o_custkey", "rn", "siren", "siret", "o_orderpriority", "c_nationkey", "n_name",
            F.substring("siret", 10, 5).alias("nic"),
            state(key, F.col("o_orderstatus")).alias("etat"),
            ((F.col("rn") == 1) & (F.col("o_custkey") % 11 != 0)).alias("siege"),
            created.cast("string").alias("creation"),
            F.when(key % 9 != 4, F.trunc(created, "year").cast("string")).alias("debut"),
            F.col("rn").cast("string").alias("numero"),
            F.col("c_mktsegment").alias("type_voie"),
            street.alias("voie"),
            F.lpad((F.col("c_nationkey") * 100 + F.col("rn") % 3).cast("string"), 5, "0").alias("cp"),
            F.when(key % 13 == 0, F.concat(F.lit("ENSEIGNE "), F.col("c_mktsegment"))).alias("enseigne"),
            F.when(F.col("previous").isNotNull(), siret(F.col("rn") - 1)).alias("previous_siret"),
            F.when(F.col("following").isNotNull(), siret(F.col("rn") + 1)).alias("next_siret"),
            state(F.col("following.o_orderkey"), F.col("following.o_orderstatus")).alias("next_etat"),
            F.col("following.o_orderdate").cast("date").cast("string").alias("next_creation"),
            F.col("following.o_orderpriority").alias("next_priority"),
        )
    )


def legal_units(spark: SparkSession, sf: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.upper("p_name").alias("name"))
    joined = _sirens(spark, sf).join(parts, F.col("c_custkey") == F.col("p_partkey"), "left")
    key = F.col("c_custkey")
    form = F.element_at(F.array(*[F.lit(s) for s in (" SAS", " SARL", " SA", "")]), (key % 4 + 1).cast("int"))
    person = (key % 10).isin(3, 6)
    return joined.select(
        "siren",
        F.when(key % 13 == 0, "C").otherwise("A").alias("etat_administratif_unite_legale"),
        F.when(person, F.lit(None)).when(key % 10 == 7, "").otherwise(F.concat("name", form)).alias("denominationUniteLegale"),
        F.when(key % 10 == 7, F.col("name")).alias("denominationUsuelle1UniteLegale"),
        F.when(key % 10 == 6, F.concat(F.lit("SG"), key.cast("string"))).alias("sigleUniteLegale"),
        F.when(person, F.upper("c_name")).alias("nomUniteLegale"),
        F.when(key % 10 == 3, "JEAN").alias("prenom1UniteLegale"),
        F.when(key % 20 == 3, "nan").alias("prenom2UniteLegale"),
        F.concat(F.lit("47."), (key % 100).cast("string")).alias("activitePrincipaleUniteLegale"),
        F.concat(F.lit("25."), (key % 100).cast("string")).alias("activitePrincipaleNAF25UniteLegale"),
        "c_custkey", "c_nationkey",
    )


def as_number(siret: str) -> Column:
    """A SIRET as it is shuffled: none begins with a zero here, and a number is half as long."""
    return F.col(siret).cast("long")


def as_siret(number: str) -> Column:
    return F.col(number).cast("string")


def links(etab: DataFrame) -> DataFrame:
    closed = F.col("etat") == "F"
    date = F.when(F.col("o_orderkey") % 19 == 0, "").otherwise(F.col("next_creation"))
    # No first order of a customer follows another one, so the next establishment is never a head office.
    forward = etab.filter(closed & F.col("next_siret").isNotNull())
    columns = lambda pred, succ, day, kept, head: [
        pred.alias("siretPredecesseur"), succ.alias("siretSuccesseur"), day.alias("dateLienSuccession"),
        head.alias("transfereSiege"), kept.alias("continuiteEconomique"),
    ]
    no = F.lit(False)
    own = forward.select(*columns(F.col("siret"), F.col("next_siret"), date, F.col("o_orderkey") % 2 == 0, no))
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    p = etab.filter(closed & urgent).select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.col("siret").alias("pred"))
    across = p.withColumn("pred", as_number("pred")).join(
        etab.select("o_orderkey", as_number("siret").alias("siret"), F.col("creation").cast("date").alias("creation"), "siege"),
        "o_orderkey",
    ).select(
        *columns(as_siret("pred"), as_siret("siret"), F.col("creation").cast("string"), F.lit(True), F.col("siege"))
    )
    back = forward.filter((F.col("next_etat") == "F") & (F.col("next_priority") == "5-LOW")).select(
        *columns(F.col("next_siret"), F.col("siret"), F.col("next_creation"), no, no)
    )
    gone = etab.filter(closed & (F.col("rn") == 3)).select(
        *columns(F.col("siret"), F.concat("siren", F.lit("99999")), F.lit("2030-01-01"), no, no)
    )
    return own.unionByName(across).unionByName(back).unionByName(gone)


def history(lines: DataFrame, etab: DataFrame) -> DataFrame:
    """One period a line item. Its day and whether it has ended are shuffled as one number."""
    ended = F.coalesce(F.col("l_linestatus") != "O", F.lit(False)).cast("int")
    periods = lines.select("l_orderkey", (F.unix_date(F.col("l_shipdate").cast("date")) * 2 + ended).alias("period"))
    owners = etab.select("o_orderkey", as_number("siret").alias("number"))
    start = F.date_from_unix_date(F.shiftright("period", 1))
    return (
        periods.join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("siret", as_siret("number"))
        .select(
            "siret", F.substring("siret", 1, 9).alias("siren"), start.cast("string").alias("dateDebut"),
            F.when(F.col("period").bitwiseAND(1) == 1, F.date_add(start, 30).cast("string")).alias("dateFin"),
        )
    )


def user_list(etab: DataFrame) -> DataFrame:
    siret, key = F.col("siret"), F.col("o_orderkey")
    v = key % 10
    spaced = F.concat(
        F.lit("SIRET "), F.substring(siret, 1, 3), F.lit(" "), F.substring(siret, 4, 6), F.lit("-"), F.substring(siret, 10, 5)
    )
    ident = (
        F.when(v == 0, siret)
        .when(v == 1, F.col("siren"))
        .when(v == 2, spaced)
        .when(v == 3, F.concat("siren", F.lit("99999")))
        .when(v == 4, F.concat(F.lit("1"), F.substring(siret, 2, 13)))
        .when(v == 5, "")
        .when(v == 6, "00000")
        .when(v == 7, F.concat(siret, F.lit(".0")))
        .when(v == 8, "804172633")
        .otherwise(F.coalesce("previous_siret", siret))
    )
    countries = ("FR", "France", "DE", "", "0", "FRA")
    country = F.element_at(F.array(*[F.lit(c) for c in countries]), (key % 6 + 1).cast("int"))
    return etab.select(
        key.cast("string").alias("ref"), ident.alias("identifiant"), country.alias("pays"),
        F.col("n_name").alias("siren"),  # a list column that bears a registry name
    )


def name_list(units: DataFrame) -> DataFrame:
    """One line per legal unit: its name with the third and fourth characters swapped."""
    name = F.coalesce(F.nullif("denominationUniteLegale", F.lit("")), "denominationUsuelle1UniteLegale", "nomUniteLegale")
    swapped = F.concat(F.substring(name, 1, 2), F.substring(name, 4, 1), F.substring(name, 3, 1), F.expr("substring(_n, 5)"))
    country = F.element_at(F.array(F.lit("FR"), F.lit("DE"), F.lit("france")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return units.withColumn("_n", name).select(
        F.col("c_custkey").alias("row_id"),
        F.when(F.col("c_custkey") % 50 == 0, "SA").otherwise(swapped).alias("nom"),
        F.when(F.col("c_custkey") % 2 == 0, F.lpad((F.col("c_nationkey") * 100 + 1).cast("string"), 5, "0"))
        .otherwise("").alias("code_postal"),
        country.alias("pays"),
    )


_STAGED: dict[tuple[str, str], Staged] = {}


def stage(spark: SparkSession, sf: str) -> Staged:
    """Write the derived tables once per application and scale."""
    tune(spark)
    sf = sf.rstrip("/")
    key = (spark.sparkContext.applicationId, sf)
    if key in _STAGED:
        return _STAGED[key]
    root = f"{shared_folder(spark)}/registra/{key[0]}/data-{hashlib.sha256(sf.encode()).hexdigest()[:12]}"
    stored = establishments(spark, sf)
    stored.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/derived")
    etab = spark.read.schema(stored.schema).parquet(f"{root}/derived")
    etab.select(
        "siret", "siren", "nic",
        F.col("etat").alias("etatAdministratifEtablissement"),
        F.col("creation").alias("date_creation_etablissement"),
        F.col("debut").alias("dateDebut"),
        F.col("siege").alias("etablissementSiege"),
        F.col("numero").alias("numeroVoieEtablissement"),
        F.col("type_voie").alias("typeVoieEtablissement"),
        F.col("voie").alias("libelleVoieEtablissement"),
        F.col("cp").alias("codePostalEtablissement"),
        F.col("n_name").alias("libelleCommuneEtablissement"),
        F.col("enseigne").alias("enseigne1Etablissement"),
        F.concat(F.lit("25."), F.col("cp")).alias("activitePrincipaleNAF25Etablissement"),
    ).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/stocketablissement")
    units = legal_units(spark, sf)
    units.drop("c_custkey", "c_nationkey").write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/stockunitelegale")
    name_list(units).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/names.parquet")
    links(etab).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/links")
    history(source(spark, sf, "lineitem"), etab).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/history")
    user_list(etab).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/list.parquet")
    _STAGED[key] = Staged(
        RegistryPaths(f"{root}/stocketablissement", f"{root}/stockunitelegale", f"{root}/links", f"{root}/history"),
        f"{root}/list.csv", f"{root}/list.parquet", f"{root}/names.parquet",
    )
    return _STAGED[key]


_WRITTEN: set[str] = set()


def list_csv(spark: SparkSession, sf: str) -> str:
    """The list as CSV, written once when a job first reads it so: most read the Parquet copy."""
    staged = stage(spark, sf)
    if staged.list_csv not in _WRITTEN:
        listed = spark.read.parquet(staged.list_parquet)
        listed.write.mode("overwrite").option("header", "true").option("sep", ";").csv(staged.list_csv)
        _WRITTEN.add(staged.list_csv)
    return staged.list_csv


def registry(spark: SparkSession, sf: str) -> Registry:
    return read_registry(spark, stage(spark, sf).registry_paths)
