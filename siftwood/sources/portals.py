"""Portals as parameter rows: which selectors find cards and fields. A new portal is a new entry, not new code."""

from __future__ import annotations

# Selectors by portal and field, in the order in which they are tried.
SELECTORS = {
    "computrabajo": {
        "card": ("article", "div.js-o-link", "div.box_offer"),
        "title": ("h2 a", "h2", ".title"),
        "company": (".fs16.fc_base.mt5", ".it-company", ".company"),
        "location": (".fs13.fc_aux.mt15", ".it-location", ".location"),
        "link": ("h2 a[href]", "a.js-o-link[href]", "a[href]"),
        "posted": (".fc_aux.fs13", ".it-posted", "time"),
        "description": (".mb10", ".description"),
        "salary": (".tag.base.mb10", ".salary", ".it-salary"),
    },
    "elempleo": {
        "card": ("article", "div.result-item", "li.result-item", "div[class*='job']", "div[class*='offer']"),
        "title": ("h2 a", "h3 a", "a[href*='/ofertas-empleo/']", "a[href*='/oferta-empleo/']", ".title"),
        "company": (".company", ".empresa", "[class*='company']", "[class*='empresa']", ".subtitulo"),
        "location": (".location", ".ciudad", "[class*='location']", "[class*='city']", "[class*='ciudad']", ".subtitulo-2"),
        "link": ("h2 a[href]", "h3 a[href]", "a[href*='/ofertas-empleo/']", "a[href*='/oferta-empleo/']", "a[href]"),
        "posted": (".date", ".fecha", "time", "[class*='date']", "[class*='fecha']"),
        "salary": (".salary", ".salario", "[class*='salary']", "[class*='salario']"),
        "description": (".description", ".resumen", "[class*='description']", "[class*='resumen']"),
        "requirements": (".contract", ".tipo-contrato", "[class*='contract']", "[class*='contrato']"),
    },
    "getonboard": {
        "card": ("article", "div[data-testid='job-card']", "li"),
        "title": ("h2 a", "h3 a", ".gb-results-list__title"),
        "company": (".company", ".gb-results-list__company", ".subtitle"),
        "location": (".location", ".gb-results-list__location", ".remote"),
        "link": ("h2 a[href]", "h3 a[href]", "a[href]"),
        "posted": (".date", ".gb-results-list__date", "time"),
        "description": (".description", ".summary"),
    },
    "indeed": {
        "card": ("div.job_seen_beacon", "a.tapItem", "div.slider_container"),
        "title": ("h2.jobTitle span", "h2 span", ".jobTitle"),
        "company": ("span.companyName", ".companyName"),
        "location": ("div.companyLocation", ".companyLocation"),
        "link": ("h2 a[href]", "a.tapItem[href]", "a[href]"),
        "posted": ("span.date", ".date"),
        "salary": (".salary-snippet", ".salaryOnly"),
    },
    "indeed_selenium": {
        "card": ("div.job_seen_beacon", "div.slider_container", "a.tapItem", "div[data-jk]"),
        "title": ("h2.jobTitle span[title]", "h2.jobTitle span", "h2 span", ".jobTitle", "a[data-jk]"),
        "company": ("span.companyName", "[data-testid='company-name']", ".companyName"),
        "location": ("div.companyLocation", "[data-testid='text-location']", ".companyLocation"),
        "link": ("h2 a[href]", "a.tapItem[href]", "a[data-jk][href]", "a[href]"),
        "posted": ("span.date", "[data-testid='myJobsStateDate']", ".date"),
        "salary": (".salary-snippet", ".salaryOnly", "[data-testid='attribute_snippet_testid']"),
        "description": (".job-snippet", "[data-testid='jobsnippet']", ".underShelfFooter"),
    },
    "linkedin": {
        "card": ("ul.jobs-search__results-list li", "div.base-search-card", "div.job-search-card"),
        "title": ("h3.base-search-card__title", "h3", "a.base-card__full-link"),
        "company": ("h4.base-search-card__subtitle", "h4", ".base-search-card__subtitle"),
        "location": (".job-search-card__location", ".base-search-card__metadata", ".job-search-card__location"),
        "link": ("a.base-card__full-link[href]", "a[href]"),
        "posted": ("time", ".job-search-card__listdate", ".job-search-card__listdate--new"),
    },
    "linkedin_selenium": {
        "card": ("div.base-card", "div.base-search-card", "div.job-search-card", "li.jobs-search-results__list-item", "div.job-card-container", "div.job-card-list", "ul.jobs-search__results-list li", "div.scaffold-layout__list-container li"),
        "title": (
            "h3.base-search-card__title", ".base-search-card__title", "a.base-card__full-link span.sr-only", "a.job-card-list__title strong", "a.job-card-list__title", "a.job-card-container__link strong", "a.job-card-container__link",
            ".job-card-list__title strong", ".job-card-list__title", ".job-card-container__title", ".artdeco-entity-lockup__title strong", ".artdeco-entity-lockup__title", "a.base-card__full-link", "strong", "h3",
        ),
        "company": (
            "h4.base-search-card__subtitle", ".base-search-card__subtitle", ".job-search-card__subtitle", "span.job-card-container__primary-description", ".job-card-container__primary-description",
            "div.artdeco-entity-lockup__subtitle", ".artdeco-entity-lockup__subtitle", ".job-card-container__company-name", ".job-card-container__subtitle", "h4",
        ),
        "location": (
            "span.job-search-card__location", ".job-search-card__location", "li.job-card-container__metadata-item", ".job-card-container__metadata-item", ".job-card-container__metadata-wrapper li",
            ".artdeco-entity-lockup__caption", ".base-search-card__metadata", ".job-search-card__metadata", ".job-card-container__metadata-wrapper",
        ),
        "link": ("a.base-card__full-link[href]", "a.job-card-container__link[href]", "a.job-card-list__title[href]", "a[href*='/jobs/view/'][href]"),
        "posted": ("time.job-search-card__listdate", "time.job-search-card__listdate--new", "time"),
        "description": (
            "div.description__text", ".job-search-card__snippet", ".job-posting-benefits__text", ".job-card-container__job-insight-text", ".job-card-container__footer-item", ".job-card-list__insight", ".base-search-card__metadata",
        ),
    },
    "magneto": {
        "card": ("article", "div.card", "div.job-card"),
        "title": ("h2 a", "h3 a", ".card-title"),
        "company": (".company", ".card-company", ".subtitle"),
        "location": (".location", ".card-location", ".city"),
        "link": ("h2 a[href]", "h3 a[href]", "a[href]"),
        "posted": (".date", ".posted", "time"),
        "description": (".description", ".summary"),
    },
    "sena": {
        "card": ("article", "div.result-item", "li.result-item", "div.card"),
        "title": ("h2 a", "h3 a", ".title"),
        "company": (".company", ".empresa", ".subtitle"),
        "location": (".location", ".ubicacion", ".city"),
        "link": ("h2 a[href]", "h3 a[href]", "a[href]"),
        "posted": (".date", ".fecha", "time"),
        "description": (".description", ".summary"),
    },
    "torre": {
        "card": ("article", "div[data-testid='job-card']", "div.card"),
        "title": ("h2 a", "h3 a", ".title"),
        "company": (".company", ".organization", ".subtitle"),
        "location": (".location", ".remote", ".city"),
        "link": ("h2 a[href]", "h3 a[href]", "a[href]"),
        "posted": (".date", ".posted", "time"),
        "description": (".description", ".summary"),
    },
}

_TEXT_TAGS = ("span", "div", "p")
# What cards of a portal need beyond selectors. hints: elements and words of a field's text where no selector
# finds any; identity: what tells cards of a page apart, the first of each is kept; own_link: the listing's URL by its identity.
RULES = {
    "elempleo": {
        "link_parts": ("/ofertas-empleo/", "/oferta-empleo/"),
        "hints": {
            "company": (_TEXT_TAGS, ("s.a.", "sas", "ltda", "s a s", "tecnologia", "company")),
            "location": (_TEXT_TAGS, ("bogota", "bogotá", "colombia", "remoto", "hibrido", "híbrido", "presencial")),
            "posted": ((*_TEXT_TAGS, "time"), ("hoy", "ayer", "hora", "horas", "día", "dias", "días")),
        },
        "whole_card": True,
    },
    "indeed_selenium": {"identity": "jk", "own_link": "https://co.indeed.com/viewjob?jk={}"},
    "linkedin_selenium": {"identity": "link", "application": True, "most_description": 500},
}


def selectors_of(portal: str) -> dict[str, tuple[str, ...]]:
    """Selectors of a portal; an unknown one is an error."""
    key = portal.strip().lower()
    if key not in SELECTORS:
        raise ValueError(f"unknown portal {portal!r}; known: {', '.join(supported())}")
    return SELECTORS[key]


def supported() -> list[str]:
    return sorted(SELECTORS)


def as_table(spark):
    """Selectors as rows (portal, field, pos, selector)."""
    rows = [(p, f, k, s) for p, fields in SELECTORS.items() for f, many in fields.items() for k, s in enumerate(many)]
    return spark.createDataFrame(rows, "portal string, field string, pos int, selector string")
