"""Fixed values the engine must share with the reference for equal results.

Everything here is a constant of the feature definitions (thresholds, sizes,
keyword lists). They are stated as plain text, in natural order, together.
Python-vs-native differences (SURVEY §1.3) are operator parameters (``native=True``,
``profile="compat"|"default"``), not code forks.
"""

# ---------------------------------------------------------------------------
# Byte window and statistics
# ---------------------------------------------------------------------------
DEFAULT_MAX_FILE_SIZE = 64 * 1024          # byte window incl. the 8 skipped bytes
HEADER_SKIP = 8                            # first bytes dropped from the window
STAT_CHUNK_COUNT = 10                      # chunks for chunk mean/std
ENTROPY_BLOCK_SIZE = 2048                  # nominal block for block entropies
ENTROPY_SAMPLE_SIZE = 10240                # file prefix used for block entropies
ENTROPY_MAX_BLOCKS = 10
ENTROPY_HIGH_THRESHOLD = 0.8
ENTROPY_LOW_THRESHOLD = 0.2
PRINTABLE_LOW, PRINTABLE_HIGH = 32, 126
NOP_BYTE = 0x90

# ---------------------------------------------------------------------------
# PE vector layout and scaling
# ---------------------------------------------------------------------------
PE_FEATURE_VECTOR_DIM = 1500
HASH_SLOT_DIM = 256
HASH_SLOT_SCALE = 1.5
NAMED_SLOT_SCALE = 0.8
SIZE_NORM_MAX = 128 * 1024 * 1024
TIMESTAMP_MAX = 2147483647
TIMESTAMP_YEAR_BASE = 1970
TIMESTAMP_YEAR_SPAN = 68
STAT_FEATURE_DIM = 49
FULL_FEATURE_DIM = STAT_FEATURE_DIM + PE_FEATURE_VECTOR_DIM

# ---------------------------------------------------------------------------
# Verdicts, routing and families
# ---------------------------------------------------------------------------
PREDICTION_THRESHOLD = 0.98
GATE_HIGH_ENTROPY_RATIO = 0.8
GATE_PACKED_SECTIONS_RATIO = 0.3
GATE_PACKER_RATIO = 0.1
GATE_SIGMOID_SLOPE = 10.0
GATE_THRESHOLD = 0.5
PACKED_SECTIONS_RATIO_THRESHOLD = 0.4
PACKER_KEYWORD_HITS_THRESHOLD = 0
FAMILY_THRESHOLD_PERCENTILE = 90
FAMILY_THRESHOLD_MULTIPLIER = 1.0
NEW_FAMILY_NAME = "New_Unknown_Family"
FAMILY_NAME_FORMAT = "Malware_Family_%d_Size%d"
FP_WEIGHT_BASE = 5.0
FP_WEIGHT_GROWTH_PER_ITER = 3.0
FP_WEIGHT_MAX = 100.0
FP_WEIGHT_INCREMENTAL = 10.0
DEFAULT_TEST_SIZE = 0.2
DEFAULT_VAL_SIZE = 0.25
DEFAULT_RANDOM_STATE = 42
EVAL_HIST_BINS = 100
EVAL_TOP_FEATURE_COUNT = 50
FAST_DEV_PER_CLASS = 5000
VIS_SAMPLE_SIZE = 20000
DENSITY_MAX_ROWS = 50000
KMEANS_N_CLUSTERS = 512
KMEANS_MAX_ITER = 100
PCA_DIMENSION_FOR_CLUSTERING = 50
FAST_PCA_DIMENSION = 20
SERVICE_MAX_BATCH_SIZE = 64
SCAN_CHUNK_FILES = 128
FEATURE_GATING_K_START = 50
FEATURE_GATING_K_STEP = 50

# ---------------------------------------------------------------------------
# Keyword lists (Python profile)
# ---------------------------------------------------------------------------
COMMON_SECTIONS = [".text", ".data", ".rdata", ".reloc", ".rsrc"]
PACKER_SECTION_KEYWORDS = ["upx", "mpress", "aspack", "themida", "petite", "pecompact", "fsg"]
SYSTEM_DLLS = ["advapi32", "comctl32", "gdi32", "kernel32", "ole32", "shell32", "user32"]
API_CATEGORY_NETWORK = ["ws2_32", "wininet", "winhttp", "internet", "socket", "connect", "send",
                        "recv", "http", "url"]
API_CATEGORY_PROCESS = ["createprocess", "openprocess", "terminateprocess", "getprocaddress",
                        "loadlibrary", "virtualallocex", "writeprocessmemory"]
API_CATEGORY_FILESYSTEM = ["createfile", "readfile", "writefile", "deletefile", "movefile",
                           "copyfile", "findfirstfile", "findnextfile", "setfileattributes",
                           "getfileattributes", "getfilesize"]
API_CATEGORY_REGISTRY = ["regopenkey", "regsetvalue", "regcreatekey", "regdeletekey",
                         "regqueryvalue", "regenumkey", "regclosekey"]

# ---------------------------------------------------------------------------
# Keyword lists (native profile)
# ---------------------------------------------------------------------------
NATIVE_SYSTEM_DLLS = ["kernel32", "user32", "gdi32", "advapi32", "ole32", "oleaut32", "shell32",
                      "comdlg32", "ws2_32", "wininet", "crypt32", "ntdll", "msvcrt", "rpcrt4",
                      "shlwapi", "comctl32", "version", "wintrust"]
NATIVE_COMMON_SECTIONS = [".text", ".data", ".rdata", ".rsrc", ".reloc", ".tls", ".pdata",
                          ".idata", ".edata"]
NATIVE_PACKER_SECTION_KEYWORDS = ["upx", "aspack", "fsg", "mpress", "petite", "pec2to", "nspack",
                                  "telock", "themida", "vmp", "vmprotect", "enigma"]

NATIVE_API_CATEGORY_NETWORK = ["internet", "http", "url", "socket", "connect", "send", "recv", "wsastartup",
                               "wininet", "ws2_32", "dns", "wget"]
NATIVE_API_CATEGORY_PROCESS = ["createprocess", "openprocess", "terminateprocess", "writeprocessmemory",
                               "readprocessmemory", "virtualallocex", "createremotethread", "getprocaddress",
                               "loadlibrary", "winexec", "shellexecute", "rtlcreateuserthread", "ntcreateprocess"]
NATIVE_API_CATEGORY_FILESYSTEM = ["createfile", "readfile", "writefile", "deletefile", "movefile", "copyfile",
                                  "setfileattributes", "getfileattributes", "findfirstfile", "findnextfile",
                                  "createdirectory", "removedirectory"]
NATIVE_API_CATEGORY_REGISTRY = ["regopenkey", "regcreatekey", "regsetvalue", "regqueryvalue", "regdeletevalue",
                                "regdeletekey", "regclosekey", "regenumkey", "regenumvalue", "regconnectregistry",
                                "regloadkey", "regsavekey"]
NATIVE_OVERLAY_ENTROPY_MIN_SIZE = 512


def keyword_lists(native: bool) -> dict:
    """The keyword lists of one profile."""
    if native:
        return {"system_dlls": NATIVE_SYSTEM_DLLS, "common_sections": NATIVE_COMMON_SECTIONS,
                "packer_sections": NATIVE_PACKER_SECTION_KEYWORDS,
                "api": {"network": NATIVE_API_CATEGORY_NETWORK, "process": NATIVE_API_CATEGORY_PROCESS,
                        "filesystem": NATIVE_API_CATEGORY_FILESYSTEM, "registry": NATIVE_API_CATEGORY_REGISTRY}}
    return {"system_dlls": SYSTEM_DLLS, "common_sections": COMMON_SECTIONS, "packer_sections": PACKER_SECTION_KEYWORDS,
            "api": {"network": API_CATEGORY_NETWORK, "process": API_CATEGORY_PROCESS,
                    "filesystem": API_CATEGORY_FILESYSTEM, "registry": API_CATEGORY_REGISTRY}}


# ---------------------------------------------------------------------------
# PE header flags
# ---------------------------------------------------------------------------
SCN_MEM_EXECUTE = 0x20000000
SCN_MEM_READ = 0x40000000
SCN_MEM_WRITE = 0x80000000
DLLCHAR_NX_COMPAT = 0x0100
DLLCHAR_DYNAMIC_BASE = 0x0040
DLLCHAR_NO_SEH = 0x0400
DLLCHAR_GUARD_CF = 0x4000
SECTION_ENTROPY_MIN_SIZE = 256
OVERLAY_ENTROPY_MIN_SIZE = 1024
LARGE_TRAILING_DATA_SIZE = 1024 * 1024

# ---------------------------------------------------------------------------
# Boosting schedule
# ---------------------------------------------------------------------------
WARMUP_ROUNDS = 200
WARMUP_START_LR = 0.001
WARMUP_TARGET_LR = 0.07
DEFAULT_INCREMENTAL_ROUNDS = 200
DEFAULT_EARLY_STOPPING_ROUNDS = 200
DEFAULT_MAX_FINETUNE_ITERATIONS = 15
