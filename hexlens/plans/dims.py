"""The one canonical dimension table of the 1549-wide feature row.

Layout: 0..48 byte statistics, 49..304 hash slots (dll 0..127, api 128..255,
section names 224..255 overlapping the api range), 305..432 named slots,
433..1548 zero padding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hexlens import config as C
from hexlens.operators.byte_stats import STAT_NAMES

# ---------------------------------------------------------------------------
# The 128 named PE slots, in vector order
# ---------------------------------------------------------------------------
NAMED_SLOTS = [
    "size", "log_size", "sections_count", "symbols_count", "imports_count", "exports_count",
    "unique_imports", "unique_dlls", "unique_apis", "section_names_count", "section_total_size",
    "section_total_vsize", "avg_section_size", "avg_section_vsize", "section_entropy_avg",
    "section_entropy_min", "section_entropy_max", "section_entropy_std", "packed_sections_ratio",
    "subsystem", "dll_characteristics", "code_section_ratio", "data_section_ratio", "code_vsize_ratio",
    "data_vsize_ratio", "has_nx_compat", "has_aslr", "has_seh", "has_guard_cf", "has_resources",
    "has_debug_info", "has_tls", "has_relocs", "has_exceptions", "dll_name_avg_length",
    "dll_name_max_length", "dll_name_min_length", "section_name_avg_length", "section_name_max_length",
    "section_name_min_length", "export_name_avg_length", "export_name_max_length", "export_name_min_length",
    "max_section_size", "min_section_size", "long_sections_count", "short_sections_count",
    "section_size_std", "section_size_cv", "executable_writable_sections", "file_entropy_avg",
    "file_entropy_min", "file_entropy_max", "file_entropy_range", "zero_byte_ratio", "printable_byte_ratio",
    "trailing_data_size", "trailing_data_ratio", "imported_system_dlls_count", "exports_density",
    "has_large_trailing_data", "pe_header_size", "header_size_ratio", "file_entropy_std", "file_entropy_q25",
    "file_entropy_q75", "file_entropy_median", "high_entropy_ratio", "low_entropy_ratio",
    "entropy_change_rate", "entropy_change_std", "executable_sections_count", "writable_sections_count",
    "readable_sections_count", "executable_sections_ratio", "writable_sections_ratio",
    "readable_sections_ratio", "executable_code_density", "non_standard_executable_sections_count",
    "rwx_sections_count", "rwx_sections_ratio", "special_char_ratio", "long_sections_ratio",
    "short_sections_ratio", "dll_imports_entropy", "api_imports_entropy", "imported_system_dlls_ratio",
    "resources_count", "alignment_mismatch_count", "alignment_mismatch_ratio", "entry_point_ratio",
    "syscall_api_ratio", "import_ordinal_only_count", "import_ordinal_only_ratio", "avg_imports_per_dll",
    "exports_name_ratio", "entry_in_nonstandard_section_flag", "tls_callbacks_count", "reloc_blocks_count",
    "reloc_entries_count", "checksum_zero_flag", "api_network_ratio", "api_process_ratio",
    "api_filesystem_ratio", "api_registry_ratio", "overlay_entropy", "overlay_high_entropy_flag",
    "packer_keyword_hits_count", "packer_keyword_hits_ratio",
    "has_.text_section", "has_.data_section", "has_.rdata_section", "has_.reloc_section", "has_.rsrc_section",
    "has_signature", "signature_size", "signature_has_signing_time", "version_info_present",
    "company_name_len", "product_name_len", "file_version_len", "original_filename_len",
    "has_upx_section", "has_mpress_section", "has_aspack_section", "has_themida_section",
    "timestamp", "timestamp_year",
]
assert len(NAMED_SLOTS) == 128

# integer-valued max/min features the reference stores as numpy integers and
# therefore drops to 0 in the vector (quirk Q2); reproduced by profile "compat"
NUMPY_INT_SLOTS = {"dll_name_max_length", "dll_name_min_length", "section_name_max_length",
                   "section_name_min_length", "export_name_max_length", "export_name_min_length",
                   "max_section_size", "min_section_size"}
# size-valued features by exact name (profile "default")
SIZE_SLOTS = {"size", "section_total_size", "section_total_vsize", "avg_section_size", "avg_section_vsize",
              "max_section_size", "min_section_size", "section_size_std", "trailing_data_size",
              "pe_header_size", "signature_size"}

HASH_DLL, HASH_API, HASH_SECTION_BASE, HASH_SECTION_MOD = 0, 128, 224, 32
STAT_OFFSET = 0
PE_OFFSET = C.STAT_FEATURE_DIM
NAMED_OFFSET = PE_OFFSET + C.HASH_SLOT_DIM

# positions used by routing (within the PE vector / full row)
PE_POS = {name: C.HASH_SLOT_DIM + i for i, name in enumerate(NAMED_SLOTS)}
ROW_POS = {name: PE_OFFSET + p for name, p in PE_POS.items()}


def meaning(index: int) -> str:
    """Meaning of one index of the 1549-wide row."""
    if index < C.STAT_FEATURE_DIM:
        return f"stat:{STAT_NAMES[index]}"
    k = index - PE_OFFSET
    if k < HASH_API:
        return f"hash:dll_slot_{k}"
    if k < C.HASH_SLOT_DIM:
        extra = f"|section_slot_{k - HASH_SECTION_BASE}" if k >= HASH_SECTION_BASE else ""
        return f"hash:api_slot_{k - HASH_API}{extra}"
    k -= C.HASH_SLOT_DIM
    if k < len(NAMED_SLOTS):
        return f"pe:{NAMED_SLOTS[k]}"
    return "padding"


def dimension_table(spark: SparkSession) -> DataFrame:
    """(index, meaning) for all 1549 dimensions - a small fixed table."""
    return spark.createDataFrame([(i, meaning(i)) for i in range(C.FULL_FEATURE_DIM)], "dim int, meaning string")
