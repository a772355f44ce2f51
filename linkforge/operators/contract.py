"""The exchange contract: a flat row per project, validated by errors and warnings, detected on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linkforge.functions.text import clean_cell, pipe_join, text_of
from linkforge.functions.urls import http_url
from linkforge.operators.rules.decide import split_flags
from linkforge.profile import DEFAULT, Profile

# The contract's columns in order.
COLUMNS = (
    "contract_version", "source_name", "source_namespace", "source_record_id", "source_record_url", "contributor_kind", "artist_name",
    "artist_alias", "artist_website", "organization_name", "project_title", "proof_title", "proof_external_url", "proof_excerpt",
    "source_granularity", "project_type", "tags", "materials", "fabrication_methods", "context_tags", "what_they_did", "why_it_matters",
    "contributor_role", "collaboration_status", "collaborators", "location", "year", "dimensions", "client_or_commissioner", "institution",
    "image_urls", "proof_confidence", "classification_confidence", "description_confidence", "classification_source", "review_status",
    "permission_status", "import_notes",
)
# Columns particular to the event, after the others.
EXTENSIONS = (
    "event_year", "event_uid", "event_name", "event_address", "event_latitude", "event_longitude", "honorarium_status", "theme_camp",
    "installation_type", "artist_text_raw", "additional_credits", "review_flags", "source_provenance", "hero_image_source_url", "hero_image_source_page",
)
# Closed sets of the contract.
KINDS = ("person", "organization", "collective", "unknown")
CONFIDENCE = ("high", "medium", "low")
PERMISSION = ("Needs permission", "Permission granted", "Permission not required", "Do not publish", "Unknown")
ENUMS = {
    "source_granularity": ("Individual project page", "Portfolio index page", "Gallery caption", "Bio/CV reference", "Press article", "Image-only inference"),
    "proof_confidence": CONFIDENCE,
    "classification_confidence": CONFIDENCE,
    "description_confidence": CONFIDENCE,
    "classification_source": ("manual", "scraper", "ai", "imported"),
    "review_status": ("Needs review", "Approved", "Rejected", "Needs better source", "Needs permission", "Duplicate"),
    "permission_status": PERMISSION,
}
MINIMUM = ("project_title", "artist_name", "organization_name", "proof_external_url")
# Older names of columns.
ALIASES = {"source_url": "source_record_url", "record_url": "source_record_url", "record_id": "source_record_id", "credit_kind": "contributor_kind", "artist": "artist_name", "alias": "artist_alias", "website": "artist_website", "organization": "organization_name", "title": "project_title", "proof_url": "proof_external_url", "excerpt": "proof_excerpt", "granularity": "source_granularity", "fabrication": "fabrication_methods", "role": "contributor_role", "client": "client_or_commissioner", "images": "image_urls", "notes": "import_notes", "permission": "permission_status"}


def contract_kind(c: Column) -> Column:
    k = F.lower(clean_cell(c))
    return (
        F.when(k.isin("person", "individual"), "person")
        .when(k.isin("organization", "studio", "theme_camp", "camp", "company", "nonprofit", "foundation"), "organization")
        .when(k.isin("collective", "crew"), "collective")
        .otherwise("unknown")
    )


def permission_status(c: Column) -> Column:
    """A known status in any case, else 'Needs permission'."""
    low = F.lower(clean_cell(c))
    out = F.when(F.lit(False), "")
    for p in PERMISSION:
        out = out.when(low == p.lower(), p)
    return out.otherwise("Needs permission")


def confidence(c: Column) -> Column:
    low = F.lower(clean_cell(c))
    return F.when(low.isin(*CONFIDENCE), low).otherwise("")


def review_state(flags: Column, title: Column, proof: Column, page: Column) -> Column:
    """Duplicate if flagged; 'Needs better source' without title and links; 'Needs review' otherwise."""
    bare = (http_url(proof) == "") & (http_url(page) == "") & (clean_cell(title) == "")
    return F.when(F.array_contains(split_flags(flags), "duplicate_candidate"), "Duplicate").when(bare, "Needs better source").otherwise("Needs review")


def to_contract(rows: DataFrame, p: Profile = DEFAULT, keep: list[str] = ()) -> DataFrame:
    """Upload rows as contract rows: names routed by kind, URLs checked, notes assembled."""
    have = set(rows.columns)
    raw = lambda n: F.col(n) if n in have else F.lit("")
    c = lambda *names: clean_cell(F.coalesce(*[F.nullif(raw(n), F.lit("")) for n in names], F.lit("")))
    url = lambda *names: http_url(F.coalesce(*[F.nullif(raw(n), F.lit("")) for n in names], F.lit("")))
    rows = rows.withColumn("_kind", contract_kind(raw("contributor_kind")))
    kind, display = F.col("_kind"), c("contributor_display_name", "contributor_name")
    name = F.when(display != "", display).otherwise(c("source_artist_credit"))
    year = F.when(c("project_year", "event_year").rlike(r"^\d{4}$"), c("project_year", "event_year")).otherwise("")
    alias, extra, flags = c("alias_name"), c("additional_contributor_credits"), c("review_flags")
    proof, page = url("proof_external_url"), url("hero_image_source_page")
    link = F.when(proof != "", proof).otherwise(page)
    notes = F.array_join(
        F.array_compact(
            F.array(
                F.when(flags != "", F.concat(F.lit("collector_review_flags="), flags)),
                F.when(kind == "unknown", "Identity left unresolved for staging review."),
                F.when(kind == "collective", "Collective credit preserved; do not auto-create a person contributor."),
                F.when(extra != "", F.concat(F.lit("Additional credits: "), extra)),
                F.when((alias != "") & (kind == "person"), "artist_alias is an alternate public name from the collector."),
            )
        ),
        " | ",
    )
    uid = c("event_uid")
    values = {
        "contract_version": F.lit(p.contract_version), "source_name": F.lit(p.source_name), "source_namespace": F.lit(p.source_namespace),
        "source_record_id": F.when(uid != "", uid).otherwise(F.btrim(F.concat_ws("-", year, c("project_slug")), F.lit("-"))),
        "source_record_url": link, "contributor_kind": kind,
        "artist_name": F.when(kind == "organization", "").otherwise(name), "artist_alias": F.when(kind == "organization", "").otherwise(alias),
        "artist_website": url("contributor_website"), "organization_name": F.when(kind.isin("organization", "collective"), name).otherwise(""),
        "project_title": c("project_title"), "proof_title": F.when(c("proof_title") != "", c("proof_title")).otherwise(c("project_title")),
        "proof_external_url": proof, "proof_excerpt": c("proof_description", "project_summary"),
        "source_granularity": F.when(link != "", "Individual project page").otherwise("Portfolio index page"),
        "project_type": c("project_type", "installation_type"), "tags": pipe_join(raw("project_tags")), "materials": pipe_join(raw("project_materials")),
        "fabrication_methods": pipe_join(raw("project_fabrication_methods")), "context_tags": pipe_join(raw("project_context_tags"), F.lit(p.context_tag)),
        "what_they_did": c("what_they_did"), "why_it_matters": c("why_it_mattered"), "contributor_role": c("role_title"),
        "collaboration_status": c("collaboration_status"), "collaborators": pipe_join(extra),
        "location": F.when(c("project_location") != "", c("project_location")).otherwise(c("event_address")), "year": year,
        "client_or_commissioner": c("client_name"), "image_urls": pipe_join(url("hero_image_url", "hero_image_source_url")),
        "proof_confidence": F.when(proof != "", "high").otherwise("low"),
        "classification_confidence": F.coalesce(F.nullif(confidence(raw("project_classification_confidence")), F.lit("")), F.lit("medium")),
        "description_confidence": F.when(c("project_summary") != "", "medium").otherwise("low"), "classification_source": F.lit("scraper"),
        "review_status": review_state(flags, raw("project_title"), raw("proof_external_url"), raw("hero_image_source_page")),
        "permission_status": permission_status(raw("permission_status")), "import_notes": notes,
        "event_year": F.coalesce(F.nullif(c("event_year"), F.lit("")), year), "event_uid": uid, "event_name": c("event_name"), "event_address": c("event_address"),
        "event_latitude": c("event_latitude"), "event_longitude": c("event_longitude"), "honorarium_status": c("honorarium_status"), "theme_camp": c("theme_camp"),
        "installation_type": c("installation_type"), "artist_text_raw": F.coalesce(F.nullif(c("source_artist_credit"), F.lit("")), display), "additional_credits": extra,
        "review_flags": flags, "source_provenance": c("source_provenance"), "hero_image_source_url": url("hero_image_source_url", "hero_image_url"), "hero_image_source_page": page,
    }
    return rows.select(*keep, *[values.get(n, F.lit("")).alias(n) for n in (*COLUMNS, *EXTENSIONS)])


def has_minimum(row=F.col) -> Column:
    some = F.lit(False)
    for n in MINIMUM:
        some = some | (clean_cell(row(n)) != "")
    return some


def validate_contract(df: DataFrame, p: Profile = DEFAULT) -> DataFrame:
    """Add ``errors`` and ``warnings``, arrays of messages."""
    kind, year, images = F.lower(clean_cell(F.col("contributor_kind"))), clean_cell(F.col("year")), clean_cell(F.col("image_urls"))
    said = lambda cond, *parts: F.when(cond, F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts]))
    bad_url = lambda n: said((clean_cell(F.col(n)) != "") & (http_url(F.col(n)) == ""), f"{n} is not a valid http(s) URL")
    errors = [
        said(clean_cell(F.col("contract_version")) != p.contract_version, f'contract_version must be "{p.contract_version}"'),
        said(~has_minimum(), "Row needs at least one of " + ", ".join(MINIMUM[:-1]) + ", or " + MINIMUM[-1]),
        said((kind != "") & ~kind.isin(*KINDS), 'Invalid contributor_kind "', kind, '"'),
        said((year != "") & ~year.rlike(r"^\d{4}$"), 'year must be YYYY, got "', year, '"'),
        *[bad_url(n) for n in ("artist_website", "proof_external_url", "source_record_url")],
        said(images.startswith("["), "image_urls must be pipe-delimited URLs, not a JSON array literal"),
    ]
    parts = F.filter(F.transform(F.split(images, r"\|"), F.trim), lambda u: (u != "") & (http_url(u) == ""))
    wrong = F.when(~images.startswith("["), F.transform(parts, lambda u: F.concat(F.lit("image_urls contains invalid URL: "), u)))
    names = [n for n in df.columns if n in (*COLUMNS, *EXTENSIONS)]
    literal = [said(F.coalesce(F.lower(F.col(n)).isin("null", "none", "undefined"), F.lit(True)), F.when(F.col(n).isNull(), f"{n} is null").otherwise(F.concat(F.lit(f'{n} contains literal "'), F.col(n), F.lit('"')))) for n in names]
    warnings = [
        said(kind == "", "contributor_kind missing; should be " + "|".join(KINDS)),
        *[said((clean_cell(F.col(n)) != "") & ~clean_cell(F.col(n)).isin(*v), f'Unknown {n} "', clean_cell(F.col(n)), '"') for n, v in ENUMS.items()],
        said((kind == "organization") & (clean_cell(F.col("organization_name")) == ""), "organization_name recommended for organization rows"),
        said((kind == "person") & (clean_cell(F.col("artist_name")) == ""), "artist_name recommended for person rows"),
    ]
    none = F.array().cast("array<string>")
    return df.withColumn("errors", F.concat(F.array_compact(F.array(*errors)), F.coalesce(wrong, none), F.array_compact(F.array(*literal)) if literal else none)).withColumn("warnings", F.array_compact(F.array(*warnings)))


def header_errors(names: list[str]) -> list[str]:
    out = [] if tuple(names[: len(COLUMNS)]) == COLUMNS else [f"the first {len(COLUMNS)} columns must match the contract"]
    return out + [f"Missing export column {c}" for c in (*COLUMNS, *EXTENSIONS) if c not in names]


def with_current_names(df: DataFrame) -> DataFrame:
    """Older column names become the contract's; where both are there the first non-empty value stays."""
    out = []
    for c in COLUMNS:
        olds = [a for a, t in ALIASES.items() if t == c and a in df.columns]
        have = ([F.col(c)] if c in df.columns else []) + [F.col(a) for a in olds]
        if have:
            out.append(F.coalesce(*[F.nullif(h, F.lit("")) for h in have], F.lit("")).alias(c))
    rest = [c for c in df.columns if c not in ALIASES and c not in COLUMNS]
    return df.select(*out, *rest)


def detect_contract(df: DataFrame, p: Profile = DEFAULT, column: str = "contract_version") -> DataFrame:
    """One row: the distinct versions, blank rows and whether the file follows the contract throughout."""
    v = clean_cell(F.col(column))
    agg = df.agg(F.sort_array(F.collect_set(F.nullif(v, F.lit("")))).alias("versions"), F.count_if(v == "").alias("blanks"), F.count(F.lit(1)).alias("rows"))
    return agg.withColumn("is_contract", (F.size("versions") == 1) & (F.col("versions")[0] == p.contract_version) & (F.col("blanks") == 0))


def promotion_route(kind: Column, artist: Column, organization: Column) -> Column:
    """Where a contract row's identity goes: person, organization, or staging for a person to decide."""
    k = contract_kind(kind)
    return F.when((k == "person") & (clean_cell(artist) != ""), "person").when(k.isin("organization", "collective") & (clean_cell(organization) != ""), "organization").otherwise("staging")


def contract_identity(row=F.col) -> Column:
    """The name that a row goes by: organization for organizations, else artist, else the other one."""
    org, artist = F.nullif(clean_cell(row("organization_name")), F.lit("")), F.nullif(clean_cell(row("artist_name")), F.lit(""))
    return text_of(F.when(contract_kind(row("contributor_kind")) == "organization", F.coalesce(org, artist)).otherwise(F.coalesce(artist, org)))
