"""packetloom: network-security and host-health analytics as Spark jobs.

Raw connection, flow and host records become labelled feature tables; models
are fitted and applied with Spark ML; scores are stacked, thresholded and
evaluated. Every step takes and returns DataFrames (or small fitted values).
"""

__version__ = "0.1.0"
