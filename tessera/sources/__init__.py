from .codebook import codebook
from .io import (TABLES, check_partitions, load, profile, read_manifest, read_partitions, read_table, read_terms,
                 table_path, terms_list, write_csv, write_partitions, write_table)

__all__ = ["TABLES", "check_partitions", "codebook", "load", "profile", "read_manifest", "read_partitions", "read_table",
           "read_terms", "table_path", "terms_list", "write_csv", "write_partitions", "write_table"]
