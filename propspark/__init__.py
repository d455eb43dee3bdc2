"""propspark: property and parcel analytics as Spark DataFrame transforms."""
