"""Regional analytics on Spark: code matching, crosswalks, overlap joins, units, topology, projection."""
