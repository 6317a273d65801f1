"""lodestrata plans"""
