from slotwise.sources.results import ResultStore
from slotwise.sources.scan import Period, inline_rows, latest_version, scan_window, snapshot_scan

__all__ = ["Period", "ResultStore", "inline_rows", "latest_version", "scan_window", "snapshot_scan"]
