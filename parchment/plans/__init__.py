"""The named queries, by family: each has a function of session and folder, and SQL where there is one."""

from parchment.plans import catalog, events, files, geometry, layout, pages, paragraphs, sources, texts, units

PLANS = [catalog.QUERIES, events.QUERIES, texts.QUERIES, layout.QUERIES, geometry.QUERIES, files.QUERIES, pages.QUERIES, paragraphs.QUERIES, units.QUERIES, sources.QUERIES]
