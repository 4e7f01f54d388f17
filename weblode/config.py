"""Limits and crawl settings, checked on the driver before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1024 * 1024


@dataclass(frozen=True)
class Limits:
    """Admission rules, and bounds on extraction that apply only when a caller sets them.

    What a page holds is never dropped by default; ``INTERACTIVE`` has the bounds of an interactive single-page analysis.
    """

    max_html_chars: int = 10 * MIB
    max_crawl_html_chars: int = 5 * MIB
    max_file_bytes: int = 100 * MIB
    max_bundle_bytes: int = 500 * MIB
    max_bundle_assets: int = 200
    max_redirects: int = 5
    max_assets: int | None = None
    max_script_chars: int | None = None
    max_player_script_chars: int | None = None
    max_onclick_chars: int | None = None
    max_settings_chars: int | None = None
    max_setting_value_chars: int | None = None

    def __post_init__(self) -> None:
        if self.max_assets is not None and self.max_assets < 1:
            raise ValueError("max_assets must be positive")


INTERACTIVE = Limits(
    max_assets=200, max_script_chars=500_000, max_player_script_chars=2 * MIB, max_onclick_chars=4_000,
    max_settings_chars=20_000, max_setting_value_chars=500)


@dataclass(frozen=True)
class CrawlConfig:
    """Deep-crawl settings; a crawl ends at its bounds or when nothing is left to visit."""

    max_depth: int = 2
    max_pages: int = 20
    follow_same_domain: bool = True
    follow_subdomains: bool = True
    follow_video_platforms: bool = True
    follow_external: bool = False
    skip_navigation: bool = True

    def __post_init__(self) -> None:
        if self.max_depth < 1 or self.max_pages < 1:
            raise ValueError("max_depth and max_pages must be positive")


@dataclass(frozen=True)
class ShallowConfig:
    """Same-host crawl settings of the single-page analysis."""

    max_depth: int = 2
    max_pages: int = 30
    batch: int = 5
    same_host_only: bool = True
    max_assets: int | None = None

    def __post_init__(self) -> None:
        if self.max_depth < 0 or self.max_pages < 1 or self.batch < 1:
            raise ValueError("max_depth must not be negative, max_pages and batch must be positive")
