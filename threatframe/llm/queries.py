"""All registered queries of the subpackage: name -> (function, SQL or None)."""

from threatframe.llm import byte_bpe, hard_negatives, html_text, language_id, license_scan, merkle, packing, pivot_index, quality, sharding, shingle_join, token_alignment, token_files  # noqa: F401
from threatframe.llm.common import QUERIES  # noqa: F401
