"""Models as plug-ins: a provider adds its answers to a table of requests. Deterministic stubs stand in for real models.

A provider is any function DataFrame -> DataFrame. Screening providers add label and rationale; extraction providers add
found and value to (study, field) rows; assessment providers add judgment to (study, domain) rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasift.operators import screening

Provider = Callable[[DataFrame], DataFrame]

#: Fixed: domains of each risk-of-bias tool, in order.
TOOL_DOMAINS = {
    "RoB2": ("Proceso de aleatorización", "Desviaciones de las intervenciones previstas", "Datos de resultado faltantes", "Medición del resultado", "Selección del resultado reportado"),
    "ROBINS-I": (
        "Confusión", "Selección de participantes", "Clasificación de las intervenciones", "Desviaciones de las intervenciones previstas", "Datos faltantes", "Medición de los resultados",
        "Selección del resultado reportado",
    ),
    "NewcastleOttawa": ("Selección", "Comparabilidad", "Resultado/Exposición"),
    "AMSTAR2": (
        "Protocolo registrado a priori", "Búsqueda exhaustiva", "Selección y extracción por duplicado", "Riesgo de sesgo de estudios incluidos", "Métodos de síntesis apropiados",
        "Evaluación del sesgo de publicación",
    ),
    "QUADAS-2": ("Selección de pacientes", "Prueba índice", "Estándar de referencia", "Flujo y tiempos"),
    "GRADE": ("Riesgo de sesgo", "Inconsistencia", "Evidencia indirecta", "Imprecisión", "Sesgo de publicación"),
}


def keyword_screener(include: str, exclude: str) -> Provider:
    """Votes by words of the title and abstract; both or neither is unclear."""

    def vote(requests: DataFrame) -> DataFrame:
        text = F.lower(F.concat_ws(" ", "title", "abstract"))
        yes, no = text.contains(include), text.contains(exclude)
        return requests.withColumns({"label": F.when(yes & ~no, "include").when(no & ~yes, "exclude").otherwise("unclear"), "rationale": F.lit("keywords")})

    return vote


def fixed(**answers: object) -> Provider:
    """The same answer to every request."""
    return lambda requests: requests.withColumns({k: F.lit(v) for k, v in answers.items()})


def vote(records: DataFrame, members: Mapping[str, Provider]) -> DataFrame:
    """record_id, model, vote_idx, label: one vote of each member for each record."""
    parts = [member(records.select("record_id", "title", "abstract")).select("record_id", F.lit(name).alias("model"), F.lit(i).alias("vote_idx"), "label") for i, (name, member) in enumerate(members.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def screen(records: DataFrame, members: Mapping[str, Provider]) -> DataFrame:
    """record_id, ensemble_label, n_votes, and the record's own id as what was looked at."""
    return screening.ensemble(records, vote(records, members)).withColumn("citations_checked", F.array("record_id"))


def extract(studies: DataFrame, keys: Sequence[str], provider: Provider) -> DataFrame:
    """study_id, key, value, status for each field of the form: needs_review if a value was found, else not_found."""
    asked = studies.select(F.col("record_id").alias("study_id"), "title", "abstract", F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
    found = F.coalesce(F.col("found") & (F.length("value") > 0), F.lit(False))
    return provider(asked).select("study_id", "key", "value", F.when(found, "needs_review").otherwise("not_found").alias("status"))


def assess(studies: DataFrame, tool: str, provider: Provider) -> DataFrame:
    """study_id, domain_idx, domain, judgment for each domain of the tool."""
    asked = studies.select(F.col("record_id").alias("study_id"), "title", "abstract", F.posexplode(F.array(*[F.lit(d) for d in TOOL_DOMAINS[tool]])).alias("domain_idx", "domain"))
    return provider(asked).select("study_id", "domain_idx", "domain", "judgment")
