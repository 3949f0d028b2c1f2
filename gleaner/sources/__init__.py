"""Where documents and sources come from."""

from gleaner.sources.documents import read_document, read_documents

__all__ = ["read_document", "read_documents"]
