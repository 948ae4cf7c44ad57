"""Settings of a crawl, passed explicitly; there are no module-wide defaults to change."""

from __future__ import annotations

from dataclasses import dataclass

FORMATS = ("md", "txt", "html", "csv", "pdf")


@dataclass(frozen=True)
class Config:
    max_depth: int = 5
    max_workers: int = 5
    delay_seconds: float = 0.5
    request_timeout: float = 30
    user_agent: str = "Mozilla/5.0 (compatible; foliate)"
    #: Address of a REST API of pages, asked before HTML for addresses with a page id; empty for none.
    api_base: str = ""
    output_format: str = "md"
    flat_output: bool = False
    incremental: bool = True
    consolidate: bool = False
    chunk_pages: bool = False
    max_chunk_words: int = 1500
    chunk_overlap_words: int = 100
    #: Label of text before the first heading, and suffix of later parts of a long section.
    preamble: str = "Introdução"
    part_label: str = "parte"
    #: Trailing " - name" or " | name" that titles lose; a pattern.
    site_names: str = ""
    #: A page's path starts with one of these, and with none of the excluded.
    included_paths: tuple[str, ...] = ("/display/", "/pages/viewpage.action", "/pages/releaseview.action")
    excluded_paths: tuple[str, ...] = (
        "/collector/", "/label/", "/login", "/logout", "/spaces/", "/plugins/", "/download/", "/rest/", "/s/", "/images/",
    )
    output_dir: str = "output"

    def __post_init__(self):
        if self.max_depth < 1:
            raise ValueError("max_depth must be 1 or more")
        if self.max_workers < 1:
            raise ValueError("max_workers must be 1 or more")
        if self.max_chunk_words < 1:
            raise ValueError("max_chunk_words must be 1 or more")
        if not 0 <= self.chunk_overlap_words < self.max_chunk_words:
            raise ValueError("chunk_overlap_words must be 0 or more and below max_chunk_words")
        if self.output_format not in FORMATS:
            raise ValueError(f"output_format must be one of {', '.join(FORMATS)}")
