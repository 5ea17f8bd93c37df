"""Sources and sinks: JSON lines, traces with rotated files, versioned snapshots, reports, fixed rows."""
