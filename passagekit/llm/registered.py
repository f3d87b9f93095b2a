"""Importing this registers the queries of the subpackage."""

from passagekit.llm import (  # noqa: F401
    alignment, chat, decontaminate, langid, licence, linededup, merkle, mixture, quality, rans, sharding, simhash, warc,
)
