"""lodestrata functions"""
