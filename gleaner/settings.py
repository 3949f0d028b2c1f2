"""Settings, with the environment variables ``GLEANER_<NAME>`` over their defaults."""

from __future__ import annotations

import os
import types
import typing
from dataclasses import dataclass, fields

from gleaner.exceptions import ConfigurationError

PREFIX = "GLEANER_"
BACKENDS, STRATEGIES = ("hybrid", "local", "remote"), ("paragraph", "sentence", "fixed")


@dataclass(frozen=True)
class Settings:
    log_level: str = "INFO"
    # chunks and shingles
    chunk_strategy: str = "paragraph"
    chunk_size: int = 500
    chunk_overlap: int = 50
    shingle_size: int = 5
    # copied passages
    jaccard_threshold: float = 0.10
    fuzz_threshold: float = 60.0
    backend: str = "hybrid"
    min_chunk_words: int = 8
    excerpt_chars: int = 300
    # remote sources
    query_max_chunks: int = 5
    query_max_chars: int = 180
    per_provider_results: int = 3
    timeout_seconds: float = 10.0
    max_source_chars: int = 20000
    fetch_full_text: bool = True
    contact_email: str | None = None
    enable_openalex: bool = True
    enable_crossref: bool = True
    enable_arxiv: bool = True
    enable_duckduckgo: bool = True
    # style
    short_sentence: int = 8
    long_sentence: int = 40
    signal_trigger: float = 0.5
    risk_high: float = 0.6
    risk_medium: float = 0.3
    short_document_words: int = 80
    # places
    output_dir: str = "output"
    corpus_path: str = "corpus"
    index_file: str = "corpus/index"
    supported_extensions: tuple[str, ...] = (".txt", ".md", ".docx", ".pdf")

    def __post_init__(self) -> None:
        for test, said in (
            (self.backend in BACKENDS, f"backend must be one of {', '.join(BACKENDS)}"),
            (self.chunk_size > 0 and self.chunk_overlap >= 0, "chunk_size must be positive and chunk_overlap not negative"),
            (self.shingle_size > 0, "shingle_size must be positive"),
            (self.jaccard_threshold <= 1, "jaccard_threshold must be 1 at most"),
            (0 <= self.fuzz_threshold <= 100, "fuzz_threshold must be from 0 to 100"),
            (self.timeout_seconds > 0, "timeout_seconds must be positive"),
            (0 <= self.risk_medium <= self.risk_high <= 1, "risk_medium and risk_high must rise from 0 to 1"),
        ):
            if not test:
                raise ConfigurationError(said)

    @classmethod
    def from_env(cls, environ: dict[str, str] | None = None, **given: object) -> Settings:
        """The defaults, under the environment, under ``given``. Lists are parted by commas."""
        environ = os.environ if environ is None else environ
        kinds, found = typing.get_type_hints(cls), {}
        for f in fields(cls):
            if (text := environ.get(PREFIX + f.name.upper())) is not None:
                found[f.name] = _value(f.name, text, kinds[f.name])
        return cls(**found | given)


def _value(name: str, text: str, kind: object) -> object:
    if typing.get_origin(kind) is tuple:
        return tuple(x.strip() for x in text.split(",") if x.strip())
    if isinstance(kind, types.UnionType):
        return text or None
    if kind is bool:
        if text.lower() in ("1", "true", "yes", "on"):
            return True
        if text.lower() in ("0", "false", "no", "off"):
            return False
        raise ConfigurationError(f"{PREFIX}{name.upper()} must be true or false")
    try:
        return kind(text)
    except ValueError as e:
        raise ConfigurationError(f"{PREFIX}{name.upper()}: {e}") from e
