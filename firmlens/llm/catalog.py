"""All queries of the subpackage and their checking SQL."""
from firmlens.llm.registry import ORACLES, QUERIES  # noqa: F401
from firmlens.llm import (block_labeller, byte_bpe, centroids, hamming_index, licences, line_quality, packing,  # noqa: F401
                          personal_data, product_codes, quotations, simhash, suffix_dedup, web_archive)
