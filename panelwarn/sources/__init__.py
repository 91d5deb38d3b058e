"""Sources and sinks (S1-S14) and the driver-table proxies."""
