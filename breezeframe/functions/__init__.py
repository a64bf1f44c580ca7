"""Column-to-column expressions; nothing here touches a DataFrame."""
