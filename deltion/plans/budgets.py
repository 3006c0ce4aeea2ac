"""K7 budget rebuild and K13 search request: compositions over budget texts and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltion.functions.text import any_term, fold_terms, norm_text
from deltion.operators import aggregates, budget, budget_text
from deltion.operators.state import replace_slice
from deltion.rules import SearchRequest
from deltion.session import settle, spread


def parse_documents(docs: DataFrame) -> DataFrame:
    """K7: lines of budget documents (project, document_id, source_document, text)."""
    keep = ["project", "document_id", "source_document"]
    parsed = budget_text.budget_lines(spread(docs.select(*keep, "text")), "text", keep)
    return parsed.withColumn("line_id", F.struct("document_id", "line_index"))


def rebuild(docs: DataFrame, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """K7: text -> lines -> replace per document -> best line per number -> totals -> verdicts.

    Returns the tables `lines`, `merged`, `summary` and `complete`; all projects in one job.
    """
    # The read lines are a table of their own and are used more than once: texts are read once.
    lines = budget.filter_invalid_lines(settle(parse_documents(docs)), ["project", "document_id"])
    if stored is not None:
        lines = replace_slice(stored, lines, ["project", "document_id"])
    merged = budget.best_line(lines, "project")
    totals = budget.consolidate_budget(merged, "project")
    amounts = budget.validate_line_amounts(merged, ["project"])
    candidates = budget.total_candidates(spread(docs.select("project", "source_document", "text")), "text", ["project", "source_document"])
    verdict = budget.validate_totals(totals, candidates, "project")
    summary = totals.join(amounts, "project", "left").join(
        verdict.select("project", "candidate_count", "reference_total", "difference", F.col("status").alias("total_status"), "totals_ok"), "project", "left"
    )
    audit = summary.select("project", "amounts_ok", "totals_ok")
    has_text = docs.select("project", (F.length("text") > 0).alias("has_text"))
    complete = aggregates.project_completeness(has_text, merged, audit, "project")
    return {"lines": lines, "merged": merged, "summary": summary, "complete": complete}


def search_request(lines: DataFrame, projects: DataFrame, request: SearchRequest) -> DataFrame:
    """Per project the lines that match a request, their cost and share of the project.

    lines: project, description, canonical_article_code, quantity, unit_price, amount;
    projects: project, status, title.
    """
    folded = norm_text(F.col("description"))
    wanted = F.lit(True)
    for term in fold_terms(request.required):
        wanted = wanted & folded.contains(term)
    wanted = wanted & ~any_term(folded, fold_terms(request.excluded))
    if request.codes:
        test = F.lit(False)
        for code in request.codes:
            test = test | F.col("canonical_article_code").startswith(code)
        wanted = wanted & test
    for column, low, high in (
        ("quantity", request.min_quantity, request.max_quantity), ("unit_price", request.min_price, request.max_price), ("amount", request.min_cost, request.max_cost),
    ):
        if low is not None:
            wanted = wanted & (F.col(column) >= F.lit(low).cast("decimal(24,6)"))
        if high is not None:
            wanted = wanted & (F.col(column) <= F.lit(high).cast("decimal(24,6)"))
    accepted = projects.filter(F.col("status").isin(list(request.statuses))) if request.statuses else projects
    hit = F.coalesce(wanted, F.lit(False))
    cost = F.sum(F.when(hit, F.col("amount")))
    per_project = lines.groupBy("project").agg(F.count_if(hit).alias("matching_lines"), cost.alias("matching_cost"), F.sum("amount").alias("project_cost"))
    found = per_project.filter("matching_lines > 0").join(accepted, "project")
    return found.withColumn("share", F.round(F.col("matching_cost") / F.col("project_cost"), 4))
