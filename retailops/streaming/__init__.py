from .ingest import ingest_changes, read_state, write_change_files

__all__ = ["ingest_changes", "read_state", "write_change_files"]
