"""Sources and sinks: parquet scans, the split-file scan, journey inputs built
from the driver tables, stage tables, CSV/JSON sinks, fingerprints."""
