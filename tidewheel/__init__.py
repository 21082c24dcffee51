"""Tidewheel: an analytics and data-processing engine on PySpark's DataFrame API."""
