"""Nested JSON payloads of the notices API, read from a landing zone: type, flatten, keep each once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.functions.parsers import clean, decimal, integer
from caudal.functions.text import utrim

# Fields of the payload; all texts, for numbers may come as either.
BUYER_FIELDS = "CodigoOrganismo NombreOrganismo RutUnidad CodigoUnidad NombreUnidad DireccionUnidad ComunaUnidad RegionUnidad RutUsuario CodigoUsuario NombreUsuario CargoUsuario".split()
DATE_FIELDS = "FechaCreacion FechaCierre FechaInicio FechaFinal FechaPubRespuestas FechaActoAperturaTecnica FechaActoAperturaEconomica FechaPublicacion FechaAdjudicacion FechaEstimadaAdjudicacion".split()
ITEM_FIELDS = "Correlativo CodigoProducto CodigoCategoria Categoria NombreProducto Descripcion UnidadMedida Cantidad".split()
NOTICE_FIELDS = (
    "CodigoExterno Nombre CodigoEstado Estado Descripcion Tipo CodigoTipo TipoConvocatoria Informada DiasCierreLicitacion CantidadReclamos FuenteFinanciamiento VisibilidadMonto "
    "FechaPublicacion FechaCierre FechaCreacion FechaInicio FechaFinal CodigoOrganismo NombreOrganismo CodigoUnidad NombreUnidad RutUnidad DireccionUnidad ComunaUnidad RegionUnidad "
    "RutUsuario CodigoUsuario NombreUsuario CargoUsuario Moneda MontoEstimado"
).split()


def _struct(fields: list[str], *more: str) -> str:
    return "struct<" + ",".join([f"{f}:string" for f in fields] + list(more)) + ">"


NOTICE = _struct(
    NOTICE_FIELDS, f"Comprador:{_struct(BUYER_FIELDS)}", f"Fechas:{_struct(DATE_FIELDS)}",
    f"Items:struct<Cantidad:string,Listado:array<{_struct(ITEM_FIELDS)}>>", "Adjudicacion:struct<Tipo:string,Fecha:string,Numero:string,NumeroOferentes:string,UrlActa:string>",
)
PAYLOAD = f"struct<Codigo:string,Descripcion:string,FechaCreacion:string,Cantidad:string,Listado:array<{NOTICE}>>"


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Payload files as text, one row a file: payload_json and its content hash."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload_json"), F.sha2("value", 256).alias("payload_sha256"))


def once(payloads: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Each payload content once, and only if not stored yet."""
    fresh = payloads.dropDuplicates(["payload_sha256"])
    return fresh if stored is None else fresh.join(stored.select("payload_sha256"), "payload_sha256", "left_anti")


def day(c: Column) -> Column:
    """Date of the styles ddMMyyyy, yyyy-MM-dd, dd/MM/yyyy and ISO date-times."""
    t = clean(c)
    return F.coalesce(
        *[F.try_to_timestamp(F.when(t.rlike(s), t), F.lit(p)).cast("date") for p, s in (("ddMMyyyy", r"^\d{8}$"), ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"), ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"))],
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.substring(t, 1, 10)).try_cast("date"),
    )


def flatten(payloads: DataFrame, keep: list[str]) -> DataFrame:
    """One row a notice of each payload, with its position; nested buyer and date fields win over flat ones.

    Payloads that are no JSON, or have no list, give no rows. Notices without a code are left out.
    """
    n = payloads.select(*keep, F.posexplode(F.from_json("payload_json", PAYLOAD)["Listado"]).alias("position", "n"))
    nested = {**{f: "Comprador" for f in BUYER_FIELDS}, **{f: "Fechas" for f in DATE_FIELDS}}

    def field(name: str) -> Column:
        flat = F.col(f"n.{name}") if name in NOTICE_FIELDS else None
        inner = F.col(f"n.{nested[name]}.{name}") if name in nested else None
        return clean(inner if flat is None else flat if inner is None else F.coalesce(clean(inner), flat))

    taken = {
        "external_notice_code": "CodigoExterno", "notice_title": "Nombre", "description": "Descripcion", "official_status_name": "Estado", "tipo": "Tipo", "buyer_org_code": "CodigoOrganismo", "buyer_org_name": "NombreOrganismo",
        "buyer_unit_code": "CodigoUnidad", "buyer_unit_name": "NombreUnidad", "buyer_region": "RegionUnidad", "currency_code": "Moneda",
    }
    dated = {"publication_date": "FechaPublicacion", "close_date": "FechaCierre", "created_date": "FechaCreacion", "award_date": "FechaAdjudicacion", "estimated_award_date": "FechaEstimadaAdjudicacion"}
    # Cleaning and parsing are two projections: a parser uses its text several times.
    texts = n.select(*keep, "position", *[field(f).alias(a) for a, f in (taken | dated).items()], F.col("n.CodigoEstado").alias("status"), F.col("n.MontoEstimado").alias("amount"), F.col("n.Items.Listado").alias("items"))
    return texts.where("external_notice_code IS NOT NULL").select(
        *keep, "position", *taken, integer(F.col("status")).alias("official_status_code"), *[day(F.col(a)).alias(a) for a in dated], decimal(F.col("amount")).cast("decimal(20,2)").alias("estimated_amount"), "items"
    )


def items(notices: DataFrame, keep: list[str]) -> DataFrame:
    """Item rows of notices; an item without a correlative gets a negative number from its position."""
    i = notices.select(*keep, "external_notice_code", F.posexplode("items").alias("pos", "i"))
    correlative = integer(F.col("i.Correlativo"))
    fallback = F.concat(F.lit("h"), F.substring(F.sha2(F.concat_ws("|", "external_notice_code", *[F.coalesce(F.col(f"i.{f}"), F.lit("")) for f in ITEM_FIELDS]), 256), 1, 16))
    return i.select(
        *keep, "external_notice_code", F.coalesce(correlative, -(F.col("pos") + 1)).alias("item_correlative"), F.coalesce(correlative.cast("string"), fallback).alias("item_code"),
        *[clean(F.col(f"i.{f}")).alias(a) for f, a in (("CodigoProducto", "product_code"), ("CodigoCategoria", "category_code"), ("Categoria", "category_name"), ("NombreProducto", "product_name"), ("Descripcion", "description"), ("UnidadMedida", "unit_of_measure"))],
        decimal(F.col("i.Cantidad")).alias("quantity"),
    )


def source_identity(payloads: DataFrame) -> DataFrame:
    """One row: SHA-256 of the number of distinct payload hashes and the sum of their 60-bit pieces, the identity of the set.

    The sums are exact and merge in any order, so no task holds the hashes.
    """
    piece = [F.conv(F.substring("payload_sha256", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    total = payloads.select("payload_sha256").distinct().agg(F.count("payload_sha256").alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).cast("string").alias(f"s{i}") for i, x in enumerate(piece)])
    return total.select(F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[f"s{i}" for i in range(4)]), 256).alias("source_identity"))


def trimmed_or_null(c: Column) -> Column:
    t = utrim(c)
    return F.when(t != "", t)
