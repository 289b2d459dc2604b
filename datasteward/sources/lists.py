"""Reference lists that ship with the package (fixed values, in natural order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from datasteward.sources.readers import normalized_lists

# Spellings of the built-in lists.
LISTS = {
    "departamentos_sv": ["San Salvador", "La Libertad", "Santa Ana", "Ahuachapán", "Sonsonate", "Usulután", "San Miguel",
                         "La Unión", "Morazán", "Cabañas", "Cuscatlán", "Chalatenango", "San Vicente", "La Paz"],
    "dias_semana_es": ["lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo"],
    "estado_civil": ["Soltero", "Soltera", "Casado", "Casada", "Divorciado", "Divorciada", "Viudo", "Viuda",
                     "Union Libre", "Union libre", "Separado", "Separada"],
    "genero_binario": ["M", "F", "Masculino", "Femenino", "masculino", "femenino", "H", "Mujer", "Hombre"],
    "meses_es": ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre",
                 "noviembre", "diciembre"],
    "nivel_educativo": ["Sin Educacion", "Primaria", "Secundaria", "Bachillerato", "Tecnico", "Tecnico Superior",
                        "Licenciatura", "Ingenieria", "Maestria", "Doctorado", "Postgrado", "Diplomado",
                        "Educacion Media", "Educacion Superior", "Ninguno"],
    "tipo_sangre": ["A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-"],
}


def builtin_lists(spark: SparkSession) -> DataFrame:
    rows = [(name, v) for name, values in LISTS.items() for v in values]
    return normalized_lists(spark.createDataFrame(rows, "list_name string, value string"))
