"""Text tables, the task catalog and episode logs."""
