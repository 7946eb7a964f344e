"""cordwood.formats"""
