"""Settings of the pipeline, with their defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

# fixed values: hosts accepted at discovery, query parameters that only track, prefixes of content types of HTML
ACCEPTED_DOMAINS = ("xinhuanet.com", "people.com.cn", "thepaper.cn", "36kr.com", "sspai.com", "ifeng.com", "caixin.com", "qq.com", "sohu.com", "sina.com.cn", "cctv.com", "chinadaily.com.cn", "jiemian.com", "yicai.com", "nbd.com.cn", "scmp.com")
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "igshid", "ved", "si", "oc", "spm", "_hsenc")
TRACKING_PREFIX = "utm_"
HTML_TYPES = ("text/html", "application/xhtml+xml")


@dataclass(frozen=True)
class Config:
    """One object for all stages. The limits of discovery (max_articles times over_fetch) and of validation (max_results) are apart on purpose."""

    accepted_domains: tuple[str, ...] = ACCEPTED_DOMAINS
    max_articles: int = 10
    over_fetch: int = 3
    max_results: int = 2
    per_host: int = 2
    head_bytes: int = 131072
    sniff_bytes: int = 8192
    min_text_bytes: int = 400
    min_text_ratio: float = 0.05
    allow_root_path: bool = False
    use_canonical: bool = True
    strip_amp: bool = True
    min_chars: int = 0
    max_chars: int = 12000
    follow_amp: bool = True
    sample_chars: int = 2000
    min_body_chars: int = 300
    chinese_only: bool = False
    summary_chars: int = 6000
    bullets: int = 5
    translation_chars: int = 6000
    clip_chars: int = 200
    summary_batch: int = 4
    translation_batch: int = 6
    polite: bool = True
    subject_prefix: str = "News digest"
    footer: str = "Sent by the digest engine"
    sender: str = "digest@example.com"
    recipients: str = ""
    items_per_mail: int = 20
    timezone: str = "Asia/Tokyo"
    dry_run: bool = False
    save_preview: bool = True
    outbox: str = "outbox"
    smtp_host: str = ""
    smtp_port: int = 587
    smtp_user: str = ""
    smtp_password: str = ""
    model_url: str = ""
    model_name: str = ""
    model_key: str = ""

    @classmethod
    def from_env(cls, prefix: str = "TIDEMARK_", env: dict[str, str] | None = None) -> Config:
        """Defaults, overridden by TIDEMARK_<FIELD>; lists are separated by commas."""
        env = env_file() | dict(os.environ) if env is None else env
        given = {}
        for f in fields(cls):
            if (raw := env.get(prefix + f.name.upper())) is not None:
                given[f.name] = parse(raw, getattr(cls(), f.name))
        return cls(**given)

    @property
    def discovery_limit(self) -> int:
        return max(1, self.max_articles) * max(1, self.over_fetch)


def env_file(path: str = ".env") -> dict[str, str]:
    """KEY=VALUE lines of a file, if there is one; the environment goes before it."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = (line.strip().removeprefix("export ").partition("=") for line in f if "=" in line and not line.lstrip().startswith("#"))
        return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}


def parse(raw: str, like: object) -> object:
    """The text as a value of the same type as `like`; what is no number leaves the default."""
    if isinstance(like, bool):
        return raw.strip().lower() in ("1", "true", "yes", "on", "y")
    if isinstance(like, tuple):
        return tuple(x.strip() for x in raw.split(",") if x.strip())
    if isinstance(like, (int, float)):
        try:
            return type(like)(raw.strip())
        except ValueError:
            return like
    return raw


def masked(secret: str) -> str:
    """A secret fit for a log."""
    return f"{secret[:6]}...{secret[-4:]}" if len(secret) >= 14 else "*" * len(secret)
