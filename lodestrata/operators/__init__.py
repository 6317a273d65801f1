"""lodestrata operators"""
