"""Where logs live: the store on Parquet, and a reader of record files."""

from .store import Store  # noqa: F401
