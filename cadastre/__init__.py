"""Land-parcel analytics on PySpark: geometry in array columns, spatial joins as grid equi-joins."""
