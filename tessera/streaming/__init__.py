from .agreement import kappa_stream
from .corrections import cell_changes, corrected_kappa, kappa_corrections
from .row_local import clean_text, clean_text_stream

__all__ = ["cell_changes", "clean_text", "clean_text_stream", "corrected_kappa", "kappa_corrections", "kappa_stream"]
