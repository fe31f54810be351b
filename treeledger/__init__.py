"""Source-tree governance on Spark: discovery, secret scanning, trash and packing plans over many repositories."""
