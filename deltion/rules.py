"""Rule tables: profiles, evaluation rules, scopes, taxonomies, user profiles.

Rules are configuration: a short Python list that is written into the plan as literals, so
matching needs no join and no shuffle. A list longer than `CHUNK` is applied in several passes
over the rows (`for_each_rule`), so a plan never grows without bound.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltion.functions.codes import safe_identifier
from deltion.functions.text import clean, unnest

CHUNK = 100
OPERATORS = [">", ">=", "<", "<=", "=", "=="]


@dataclass(frozen=True)
class SearchProfile:
    profile_id: str
    name: str = ""
    document_types: tuple = ()
    exact_phrases: tuple = ()
    optional_terms: tuple = ()
    revision_codes: tuple = ()
    minimum_confidence: float = 0.60


@dataclass(frozen=True)
class EvaluationRule:
    rule_id: str
    label: str = ""
    document_types: tuple = ()
    phrases: tuple = ()
    operator: str | None = None
    threshold: float | None = None
    score: float = 1.0
    severity: str = "info"


@dataclass(frozen=True)
class AmbiguousAlias:
    alias: str
    positive_context: tuple = ()
    negative_context: tuple = ()


@dataclass(frozen=True)
class Scope:
    """A place of interest; `units` and `nuts` are used for regions."""

    name: str
    aliases: tuple = ()
    ambiguous: tuple = ()
    units: tuple = ()
    nuts: tuple = ()


@dataclass(frozen=True)
class UserProfile:
    user: str
    include: tuple = ()
    exclude: tuple = ()
    category_ids: tuple = ()
    min_budget: float | None = None
    max_budget: float | None = None

    @property
    def active(self) -> bool:
        return bool(self.include or self.exclude or self.category_ids) or self.min_budget is not None or self.max_budget is not None


@dataclass(frozen=True)
class SearchRequest:
    """What a project must and must not contain, and which statuses count."""

    required: tuple = ()
    excluded: tuple = ()
    codes: tuple = ()
    min_quantity: float | None = None
    max_quantity: float | None = None
    min_price: float | None = None
    max_price: float | None = None
    min_cost: float | None = None
    max_cost: float | None = None
    statuses: tuple = field(default_factory=tuple)


def _texts(value) -> tuple:
    return tuple(str(v) for v in value or [] if v is not None and str(v).strip()) if isinstance(value, (list, tuple)) else ()


def load_search_profile(data: dict, default_id: str = "profile") -> SearchProfile:
    """Search profile from its configuration; a minimum confidence of 0 or none means 0.60."""
    head, terms = data.get("profile") or {}, data.get("terms") or {}
    pid = str(head.get("id") or default_id)
    return SearchProfile(
        profile_id=pid,
        name=str(head.get("name") or pid),
        document_types=_texts((data.get("document_types") or {}).get("include")),
        exact_phrases=_texts(terms.get("exact_phrases")),
        optional_terms=_texts(terms.get("optional_terms")),
        revision_codes=_texts((data.get("codes") or {}).get("revision_codes")),
        minimum_confidence=float((data.get("matching") or {}).get("minimum_confidence") or 0.60),
    )


def load_evaluation_rules(data: dict) -> list[EvaluationRule]:
    """Evaluation rules; missing ids, labels, scores and severities get their defaults."""
    out = []
    for n, item in enumerate(data.get("rules") or [], start=1):
        if not isinstance(item, dict):
            continue
        numeric = item.get("numeric") or {}
        op = str(numeric.get("operator") or "").strip() or None
        if op and op not in OPERATORS:
            raise ValueError(f"unsupported operator {op} in rule {item.get('id') or n}")
        rid = str(item.get("id") or f"rule_{n}")
        out.append(
            EvaluationRule(
                rule_id=rid,
                label=str(item.get("label") or item.get("id") or f"Rule {n}"),
                document_types=_texts(item.get("document_types")),
                phrases=_texts(item.get("phrases")),
                operator=op,
                threshold=None if numeric.get("threshold") in (None, "") else float(numeric["threshold"]),
                score=float(item.get("score") or 1.0),
                severity=str(item.get("severity") or "info"),
            )
        )
    return out


def load_scopes(items: Sequence[dict]) -> list[Scope]:
    """Places of interest with their plain and ambiguous names."""
    return [
        Scope(
            name=str(s.get("name") or s.get("id") or ""),
            aliases=_texts(s.get("aliases")),
            ambiguous=tuple(
                AmbiguousAlias(a["alias"], _texts(a.get("positive_context")), _texts(a.get("negative_context")))
                for a in s.get("ambiguous_aliases") or []
                if str(a.get("alias") or "").strip()
            ),
            units=_texts(s.get("included_regional_units")),
            nuts=_texts(s.get("nuts_prefixes")),
        )
        for s in items
    ]


def rules_table(spark: SparkSession, rules: Sequence, schema: str) -> DataFrame:
    """A rule list as a small table, for reports and equi-joins on an attribute of the rule."""
    names = [part.split()[0] for part in schema.split(", ")]
    rows = [asdict(r) for r in rules]
    return spark.createDataFrame([tuple(list(r[n]) if isinstance(r[n], tuple) else r[n] for n in names) for r in rows], schema)


def for_each_rule(df: DataFrame, rules: Sequence, build: Callable[[object], Column], keep: list[str]) -> DataFrame:
    """One output row per (row, rule) whose `build(rule)` struct is not null.

    Replaces a rules x rows join: candidates of one row are built in place and exploded.
    """
    columns = [F.col(c) for c in keep]
    passes = []
    for at in range(0, len(rules), CHUNK):
        hits = F.array_compact(F.array(*[build(r) for r in rules[at : at + CHUNK]]))
        passes.append(unnest(df, columns, hits, "_hit").select(*keep, "_hit.*"))
    return reduce(DataFrame.unionByName, passes)


def validate_rules(df: DataFrame, fallback: Column | None = None, strict: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """A10: a table of rules (id, label, phrases, operator, threshold, score, severity) made valid.

    Rules without phrases are dropped, ids made safe, defaults filled. A numeric condition with an
    unknown operator stops the job when `strict`, otherwise the rule is marked.
    """
    fallback = fallback if fallback is not None else F.lit("rule")
    op = F.trim(F.coalesce(F.col("operator"), F.lit("")))
    numeric = (op != "") & F.col("threshold").isNotNull()
    bad = numeric & ~op.isin(OPERATORS)
    rule_id = safe_identifier(F.coalesce(F.col("id"), F.lit("")), fallback)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("unsupported operator for "), rule_id))).otherwise(rule_id) if strict else rule_id
    phrases = F.filter(F.coalesce(F.col("phrases"), F.array().cast("array<string>")), lambda p: F.length(F.trim(p)) > 0)
    return (
        df.withColumn("phrases", phrases)
        .filter(F.size("phrases") > 0)
        .select(
            *keep,
            checked.alias("rule_id"),
            clean(F.coalesce(F.nullif(F.col("label"), F.lit("")), rule_id)).alias("label"),
            "phrases",
            F.when(numeric, op).alias("operator"),
            F.when(numeric, F.col("threshold")).alias("threshold"),
            F.coalesce(F.nullif(F.col("score"), F.lit(0.0)), F.lit(1.0)).alias("score"),
            F.coalesce(F.nullif(F.trim("severity"), F.lit("")), F.lit("info")).alias("severity"),
            bad.alias("invalid_operator"),
        )
    )
