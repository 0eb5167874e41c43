from seedspread.sources.datasets import (
    load_documents,
    load_points,
    read_labeled_text,
    read_paired_text,
    read_table,
    scale_features,
    write_labeled_text,
)

__all__ = ["load_documents", "load_points", "read_labeled_text", "read_paired_text", "read_table",
           "scale_features", "write_labeled_text"]
