"""Runnable jobs over the library: `python -m jobs.text_density --help`, `python -m jobs.zoom_archive --help`."""
