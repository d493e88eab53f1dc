"""folium: document and evaluation analytics as PySpark DataFrame programs."""
