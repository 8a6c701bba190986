"""Fixed values of the point-cloud preview format, and its errors."""

# The container's layout and the spectrum's grid.
MAGIC = b"CPOS"
CONTAINER_VERSION = (1, 0)
ALGORITHM_VERSION = (1, 0, 0)
HEADER_SIZE = 128
ENDIAN_MARKER = 0x01020304
FLAGS = 1
RECORD_SIZE = 8
SPECTRUM_MIN_DA = 0.0
SPECTRUM_MAX_DA = 300.0
SPECTRUM_BIN_DA = 0.05
SPECTRUM_BINS = 6000
DEFAULT_MAX_POINTS = 499_000
UINT32_MAX = 4_294_967_295

TRUE_COUNTS_OFFSET = HEADER_SIZE
STORED_COUNTS_OFFSET = TRUE_COUNTS_OFFSET + 4 * SPECTRUM_BINS
RECORDS_OFFSET = STORED_COUNTS_OFFSET + 4 * SPECTRUM_BINS
#: The largest quantized value.
STEPS = 65535.0


class FormatVersionError(ValueError):
    """A file needs a version of the format that isn't supported."""
