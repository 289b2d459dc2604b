"""Anonymisation techniques and name-based sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words in a column name that mark personal data.
PII_WORDS = [
    "nombre", "apellido", "identificacion", "documento", "dni", "cedula",
    "direccion", "telefono", "email", "correo", "fecha_nacimiento",
    "numero_seguro", "numero_afiliacion", "pasaporte", "rut", "curp",
]
# Words in a column name that mark sensitive data.
SENSITIVE_WORDS = [
    "diagnostico", "diagnostic", "enfermedad", "salud_mental", "vih",
    "discapacidad", "genetico", "genetica", "sexual", "reproductivo",
    "adiccion", "tratamiento", "medicamento", "internamiento",
    "fecha_ingreso", "alta_hospitalaria", "procedimiento",
]


def pseudonymize(v: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(v.cast("string"), F.lit(salt)), 256), 1, 16)


def generalize_date(v: Column) -> Column:
    return F.year(v)


def generalize_sensitive(v: Column) -> Column:
    return F.when(v.isNotNull(), F.lit("registrado"))


def mask(v: Column, keep: int = 4) -> Column:
    """Keep the last characters, replace the rest by '*'."""
    n = F.length(v)
    return F.when(n <= keep, v).otherwise(
        F.concat(F.repeat(F.lit("*"), n - keep), F.right(v, F.lit(keep))))


def k_anonymity(df: DataFrame, quasi_ids: list[str], k: int) -> DataFrame:
    """Blank the quasi-identifiers of rows whose combination occurs fewer than k times.

    The counts are a pre-aggregated table joined back, so a combination that holds
    most rows never has to sit in one window partition.
    """
    rare = (df.groupBy(*quasi_ids).agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") < k)
            .select(*[F.col(c).alias(f"_q_{c}") for c in quasi_ids], F.lit(True).alias("_rare")))
    cond = None
    for c in quasi_ids:
        eq = F.col(c).eqNullSafe(F.col(f"_q_{c}"))
        cond = eq if cond is None else cond & eq
    joined = df.join(rare, cond, "left")
    return joined.select(*[
        (F.when(F.col("_rare").isNull(), F.col(c)).alias(c) if c in quasi_ids else F.col(c))
        for c in df.columns
    ], F.coalesce(F.col("_rare"), F.lit(False)).alias("suppressed"))


def anonymize(df: DataFrame, classification: dict[str, str], salt: str) -> DataFrame:
    """Apply the technique that each column's class asks for: pii, sensible, suppress."""
    types = dict(df.dtypes)
    out = []
    for c in df.columns:
        cls = classification.get(c, "publico")
        if cls == "suppress":
            continue
        if cls == "pii":
            is_date = any(w in types[c] for w in ("date", "timestamp")) or "fecha" in c.lower()
            v = generalize_date(F.col(c)) if is_date else pseudonymize(F.col(c), salt)
        elif cls == "sensible":
            v = generalize_sensitive(F.col(c))
        else:
            v = F.col(c)
        out.append(v.alias(c))
    return df.select(*out)


def sensitivity(names: DataFrame, column: str = "column", priority: str = "pii") -> DataFrame:
    """Add is_pii, is_sensitive and the keyword found in each column name.

    A keyword may sit inside the lower-cased name or inside the name without
    separators. The smallest matching keyword is reported.
    """
    low = F.lower(F.trim(F.col(column)))
    squeezed = F.regexp_replace(low, r"[_\-\s]", "")

    def first_hit(words: list[str]) -> Column:
        return F.coalesce(*[F.when(low.contains(w) | squeezed.contains(w), F.lit(w))
                            for w in sorted(words)])

    pii, sens = first_hit(PII_WORDS), first_hit(SENSITIVE_WORDS)
    df = names.withColumns({"_pii": pii, "_sens": sens})
    if priority == "pii":
        is_pii = F.col("_pii").isNotNull()
        is_sens = F.col("_pii").isNull() & F.col("_sens").isNotNull()
    else:
        is_sens = F.col("_sens").isNotNull()
        is_pii = F.col("_sens").isNull() & F.col("_pii").isNotNull()
    return df.withColumns({
        "is_pii": is_pii, "is_sensitive": is_sens,
        "sensitivity_keyword": F.when(is_pii, F.col("_pii")).when(is_sens, F.col("_sens")),
    }).drop("_pii", "_sens")
