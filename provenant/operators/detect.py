"""Pages that are no content: blocks, consent walls, and error pages that pretend to be good."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import markup
from provenant.operators.extract import scanned

FLOOR = 200  # bytes of visible text below which a page is blocked


@dataclass(frozen=True)
class Signature:
    id: str
    pattern: str
    scope: str = "body"
    kind: str = "regex"


# What is looked for, in this order.
BLOCKS = (
    Signature("cf_mitigated_header", "cf-mitigated", "header"),
    Signature("onetrust_cmp", "#onetrust-consent-sdk", kind="css"),
    Signature("usercentrics_cmp", "#usercentrics-root", kind="css"),
    Signature("didomi_cmp", "#didomi-host", kind="css"),
    Signature("generic_cmp", ".cmp-container", kind="css"),
    Signature("cloudflare_challenge", "cf-browser-verification"),
    Signature("cloudflare_just_a_moment", r"Just a moment\.\.\."),
    Signature("incapsula", "_Incapsula_Resource"),
    Signature("reference_id", r"Reference #\d"),
    Signature("hcaptcha", r"hcaptcha\.com"),
    Signature("recaptcha", r"google\.com/recaptcha"),
)
SOFT_404 = (
    Signature("soft_404_title", r"(?i)\b404\b|not found|page not found", "title"),
    Signature("soft_404_body_not_found", r"(?i)page (you requested |you were looking for )?(could not|couldn't|cannot|can't) be found"),
    Signature("soft_404_error_container", ".error-404", kind="css"),
)


def signatures(base: tuple[Signature, ...], own: tuple[Signature, ...] = (), replace: bool = False) -> tuple[Signature, ...]:
    """A source's own signatures after the base ones, or in their place; ids must differ, and patterns must be ones."""
    out = own if replace else base + own
    if len({s.id for s in out}) < len(out):
        raise ValueError("signature ids must be unique")
    for s in out:
        if s.kind == "regex":
            try:
                re.compile(s.pattern)
            except re.error as wrong:
                raise ValueError(f"signature {s.id}: {wrong}") from wrong
        elif s.kind == "css":
            markup.Automaton([s.pattern])
        else:
            raise ValueError(f"signature {s.id}: {s.kind} is no kind")
        if s.scope not in ("body", "title", "header"):
            raise ValueError(f"signature {s.id}: {s.scope} is no scope")
    return out


def facts_ask(blocks: tuple[Signature, ...] = BLOCKS, soft: tuple[Signature, ...] = SOFT_404) -> markup.Facts:
    """What ``detected`` asks of a page."""
    return markup.Facts(tuple(s.pattern for s in blocks + soft if s.kind == "css"))


def _hit(s: Signature, html: Column, headers: Column) -> Column:
    if s.kind == "css":
        return F.array_contains("facts.matches", s.pattern)
    return {"body": html, "title": F.col("facts.title"), "header": headers}[s.scope].rlike(s.pattern)


def detect(pages: DataFrame, blocks: tuple[Signature, ...] = BLOCKS, soft: tuple[Signature, ...] = SOFT_404, html: str = "html", headers: str | None = None, status: str = "http_status") -> DataFrame:
    """``detected`` after a pass over the pages that asks for nothing else."""
    return detected(scanned(pages, {"facts": facts_ask(blocks, soft)}, html), blocks, soft, html, headers, status).drop("facts")


def detected(pages: DataFrame, blocks: tuple[Signature, ...] = BLOCKS, soft: tuple[Signature, ...] = SOFT_404, html: str = "html", headers: str | None = None, status: str = "http_status") -> DataFrame:
    """``pages`` (html, facts, ...) with ``block`` and ``soft_404``: the id of the first signature that holds, or null.

    After the list of blocks come a refresh to a consent page and too little visible text. Only pages with status
    200 can be soft errors. ``headers`` is a map; its lines are looked at in lower case.
    """
    lines = F.lower(F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")) if headers else F.lit("")
    block = F.coalesce(*[F.when(_hit(s, F.col(html), lines), s.id) for s in blocks], F.when(F.col("facts.consent"), "meta_refresh_consent"), F.when(F.col("facts.visible") < FLOOR, "text_floor"))
    error = F.when(F.col(status) == 200, F.coalesce(*[F.when(_hit(s, F.col(html), lines), s.id) for s in soft]))
    return pages.withColumns({"block": block, "soft_404": error})
